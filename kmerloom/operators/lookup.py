"""The lookup table: k-mers of labelled sequences in categories, and sequences annotated with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import canonical, has_run
from .pairs import kmers


def gene_of(header: Column) -> Column:
    """L3: what the last parentheses of a header hold, else the part before the first . or - of its first word."""
    cleaned = F.regexp_replace(header, r",?\s*transcript variant[^,]*", "")
    inside = F.regexp_extract(cleaned, r"^.*\(([^()]*)\)", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(short_header(header), r"^([^.-]*)", 1))


def short_header(header: Column) -> Column:
    """L4: up to the first space or tab."""
    return F.split(header, "[ \t]")[0]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """Canonical valid k-mers of (file, header, seq), with their counts: file, header, kmer, n."""
    w = kmers(seqs.select("file", "header", "seq"), k, as_canonical=True)
    return w.groupBy("file", "header", "kmer").agg(F.count("*").alias("n"))


def genome_table(seqs: DataFrame, k: int = 15, run: int = 0, count_limit: int = 1) -> DataFrame:
    """L1: lookup rows (kmer, category, file, labels, cnt) of genome files.

    Category 1: once, in this file alone (labels: the header). 2: often, in this file alone (cnt). 3: in other
    files too, but in this one at most `count_limit` times (labels: the headers). Others are listed with category
    4. k-mers with a run of `run` equal bases are left out; 0 keeps all.
    """
    h = file_kmers(seqs, k).where(~has_run(F.col("kmer"), run))
    f = h.groupBy("kmer", "file").agg(F.sum("n").alias("c"), F.array_sort(F.collect_set(short_header(F.col("header")))).alias("labels"))
    f = f.withColumn("files", F.count("*").over(Window.partitionBy("kmer")))
    only = F.col("files") == 1
    cat = F.when(only & (F.col("c") == 1), 1).when(only, 2).when(F.col("c") <= count_limit, 3).otherwise(4)
    return f.select("kmer", cat.alias("category"), "file", F.when(cat.isin(1, 3), F.col("labels")).otherwise(F.array().cast("array<string>")).alias("labels"), F.col("c").cast("bigint").alias("cnt"))


def transcript_groups(seqs: DataFrame, k: int) -> DataFrame:
    """Per file and k-mer the numbers of genes and variants, and one of each: file, kmer, genes, variants, gene, variant."""
    h = file_kmers(seqs, k).withColumn("gene", gene_of(F.col("header"))).withColumn("variant", short_header(F.col("header")))
    v = h.groupBy("file", "kmer", "gene", "variant").agg(F.lit(1).alias("x")).groupBy("file", "kmer", "gene").agg(F.count("*").alias("v"), F.min("variant").alias("variant"))
    return v.groupBy("file", "kmer").agg(F.count("*").alias("genes"), F.sum("v").alias("variants"), F.min("gene").alias("gene"), F.min("variant").alias("variant"))


def transcriptome_table(seqs: DataFrame, k: int = 15) -> DataFrame:
    """L2: lookup rows of transcriptome files: a k-mer of one variant has its label, of one gene the gene's.

    Category 1: labelled, in this file alone; 3: labelled, in others too; 2: several genes, in this file alone
    (cnt: their number); else 4. Runs are not filtered here.
    """
    g = transcript_groups(seqs, k).withColumn("files", F.count("*").over(Window.partitionBy("kmer")))
    only, label = F.col("files") == 1, F.when(F.col("variants") == 1, F.col("variant")).when(F.col("genes") == 1, F.col("gene"))
    cat = F.when(label.isNotNull() & only, 1).when(label.isNotNull(), 3).when(only, 2).otherwise(4)
    return g.select("kmer", cat.alias("category"), "file", F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>")).alias("labels"), F.col("genes").cast("bigint").alias("cnt"))


def unique_to_file(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, file) of k-mers that one file alone has."""
    f = file_kmers(seqs, k).select("kmer", "file").distinct()
    return f.groupBy("kmer").agg(F.count("*").alias("n"), F.min("file").alias("file")).where(F.col("n") == 1).select("kmer", "file")


def all_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """The union of the files' k-mers, with the number of files of each."""
    return file_kmers(seqs, k).select("kmer", "file").distinct().groupBy("kmer").agg(F.count("*").alias("n_files"))


def query(seqs: DataFrame, lookup: DataFrame, k: int = 15, run: int = 0, skip: int = 0) -> DataFrame:
    """Every (skip + 1)-th k-mer of (qid, seq): qid, pos, kmer, code, file, labels, cnt.

    Codes, the first that fits: N invalid, P a run of `run`, U not in the table, else the category. A k-mer that
    several files list gives its best category, ties by file. Sequences shorter than k give no rows.
    """
    one = lookup.groupBy("kmer").agg(F.min(F.struct("category", "file", "labels", "cnt")).alias("l"))
    q = kmers(seqs.select("qid", F.upper("seq").alias("seq")), k, keep_invalid=True).where((F.col("pos") - 1) % (skip + 1) == 0)
    q = q.withColumn("key", F.when(F.col("is_valid"), canonical(F.col("kmer"))))
    hit = q.join(one.withColumnRenamed("kmer", "key"), "key", "left")
    code = F.when(~F.col("is_valid"), "N").when(has_run(F.col("kmer"), run), "P").when(F.col("l").isNull(), "U").otherwise(F.col("l.category").cast("string"))
    show = lambda c: F.when(code.isin("1", "2", "3", "4"), F.col(f"l.{c}"))
    return hit.select("qid", "pos", "kmer", code.alias("code"), show("file").alias("file"), show("labels").alias("labels"), show("cnt").alias("cnt"))


def hit_text() -> Column:
    """One hit in a plain report: its code, and the label or file and count that belong to it."""
    label = F.array_join(F.col("labels"), "|")
    return F.when(F.col("code").isin("1", "3"), F.concat_ws(":", F.col("code"), F.col("file"), label)).when(F.col("code") == "2", F.concat_ws(":", F.col("code"), F.col("file"), F.col("cnt").cast("string"))).otherwise(F.col("code"))


def _listed(hits: DataFrame, value: Column, sep: str) -> DataFrame:
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("a"))
    return rows.select("qid", F.array_join(F.transform("a", lambda x: x["v"]), sep).alias("query_res"))


def report_plain(hits: DataFrame, sep: str = ", ") -> DataFrame:
    """L6 plain: all hits of a query in order."""
    return _listed(hits, hit_text(), sep)


def report_ids(hits: DataFrame, sep: str = ", ") -> DataFrame:
    """L6 ids: the codes alone."""
    return _listed(hits, F.col("code"), sep)


def report_empty(hits: DataFrame) -> DataFrame:
    """L6 empty."""
    return hits.select("qid").distinct().withColumn("query_res", F.lit(""))


def report_concise(hits: DataFrame, sep: str = ", ") -> DataFrame:
    """L6 concise: runs of equal hits as code:<start:n>:label; N, P and U end a run and are not shown.

    Starts count k-mers from 0. Gaps and islands: a run is what keeps the difference of two row numbers.
    """
    what = hit_text()
    h = hits.withColumn("what", what)
    w = Window.partitionBy("qid").orderBy("pos")
    h = h.withColumn("i", F.row_number().over(w) - 1).withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("qid", "what").orderBy("pos")))
    h = h.where(F.col("code").isin("1", "2", "3", "4"))
    runs = h.groupBy("qid", "what", "island", "code").agg(F.min("i").alias("start"), F.count("*").alias("n"))
    rest = F.expr("substring(what, length(code) + 2)")
    text = F.concat(F.col("code"), F.lit(":<"), F.col("start"), F.lit(":"), F.col("n"), F.lit(">"), F.when(rest != "", F.concat(F.lit(":"), rest)).otherwise(F.lit("")))
    listed = _listed(runs.withColumn("pos", F.col("start")).withColumn("v", text), F.col("v"), sep)
    return hits.select("qid").distinct().join(listed, "qid", "left").select("qid", F.coalesce("query_res", F.lit("")).alias("query_res"))


def report_stats(hits: DataFrame) -> DataFrame:
    """Qid, query_stats."""
    codes = ("1", "2", "3", "4", "U", "P", "N")
    n = hits.groupBy("qid").agg(*[F.count_if(F.col("code") == c).alias(c) for c in codes])
    return n.select("qid", F.format_string(", ".join(f"{c}: %d" for c in codes), *[F.col(c) for c in codes]).alias("query_stats"))


def annotate_extendors(stats: DataFrame, lookup: DataFrame, n: int, k: int = 15, run: int = 0) -> DataFrame:
    """most_freq_extendor_i_query_res and _query_stats beside the targets of an anchor table, `-` where none.

    Results keep the number of their target (L9), so a missing one in the middle moves nothing.
    """
    cols = [F.struct(F.lit(i).alias("i"), F.concat("anchor", f"most_freq_target_{i}").alias("seq")) for i in range(1, n + 1)]
    q = stats.select("anchor", F.explode(F.array(*cols)).alias("x")).where(F.col("x.seq").isNotNull()).select(F.concat_ws(":", "anchor", "x.i").alias("qid"), F.col("x.seq").alias("seq"))
    hits = query(q, lookup, k, run)
    both = report_concise(hits).join(report_stats(hits), "qid")
    parts = both.select(F.split("qid", ":")[0].alias("anchor"), F.split("qid", ":")[1].cast("int").alias("i"), "query_res", "query_stats")
    wide = parts.groupBy("anchor").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"most_freq_extendor_{i}_{c}") for i in range(1, n + 1) for c in ("query_res", "query_stats")])
    out = stats.join(wide, "anchor", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("-")) for c in wide.columns if c != "anchor"})


def annotate(table: DataFrame, column: str, keys: list[str], lookup: DataFrame, k: int = 15, run: int = 0) -> DataFrame:
    """`table` with query_res and query_stats of the sequences in `column`; `keys` tell its rows apart."""
    name = F.concat_ws(":", *keys).alias("qid")
    hits = query(table.select(name, F.col(column).alias("seq")), lookup, k, run)
    both = report_concise(hits).join(report_stats(hits), "qid")
    out = table.withColumn("qid", name).join(both, "qid", "left").drop("qid")
    return out.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("query_res", "query_stats")})


def query_many(inputs: dict[str, DataFrame], lookup: DataFrame, k: int = 15, run: int = 0) -> dict[str, DataFrame]:
    """Several inputs against one table, which is kept in memory and on disk between them."""
    kept = lookup.persist()
    return {name: query(seqs, kept, k, run) for name, seqs in inputs.items()}
