"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, and the mix of sources.

Part of subpackage llm. Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import decontaminate, jaccard, mixing, secrets, toxicity
from kmerloom.llm.common import discard, materialise, scratch_tables, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones outside fold 0."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"), name="_toxicity")
    return scored.where(F.col("_toxicity") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 75 of 100 five-word shingles, the document of the smallest id."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from: their columns, size, source_size, target and taken.

    Where a document's column has one of these names, the mix's own is called mix_<name>.
    """
    # Other columns travel under names of their own, as theirs may clash with those of the mix.
    rest = {c: f"_keep{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "source"))}
    lean = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(k) for c, k in rest.items()])
    out = mixing.mix_documents(lean, keep=tuple(rest.values())).where("taken > 0")
    own = [F.col(rest.get(c, c)).alias(c) for c in docs.columns]
    return out.select(*own, *[F.col(c).alias(f"mix_{c}" if c in rest else c) for c in ("size", "source_size", "target", "taken")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifier and the components can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    What a stage has written on its way, and the table of the stage before it, go as soon as its own table stands.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_tables(spark) as written:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            written.remove(docs._kmerloom_path)
        if before is not None:
            discard(before)
        before = docs
    return docs
