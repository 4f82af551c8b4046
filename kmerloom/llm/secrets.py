"""Secret scans: spans of credential patterns, told apart by how many repositories and owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base patterns, in the order of their kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Further public credential shapes, which the ownership statistics have to confirm. A run of letters that can't be
# one is passed in one step: a start has no such letter before it, and what is read is not given back.
EXTRA = {
    "github": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "google": r"AIza[A-Za-z0-9_-]{30,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+",
    "url": r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/:@]{6,}+@",
}
KINDS = ("assign", "access", "hex", *EXTRA)
#: The part of a match that is the secret itself, by kind; elsewhere it is all of it.
VALUES = {"assign": (ASSIGN, 2), "url": (r":([^:@]*)@$", 1)}
#: A value that so many owners hold is a copied example; so is one in so many repositories if two owners hold it.
WIDE_OWNERS, WIDE_REPOS = 5, 10
#: Matches that are placed together.
CHUNK = 64
_SPANS = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(kind: str, pattern: str, least: int, group: int = 0, hint: str | None = None) -> Column:
    """Array of (start, kind, stop, value) of the leftmost matches of `_text`, in code points.

    `value` is the secret itself, without key name, spaces and quotes, so that one secret is one value in any kind of span.

    The text between matches comes from split(), the matches from regexp_extract_all(): their lengths, added up,
    are the positions. They are added up in chunks, so that no long list is copied for each match. A match shorter
    than `least` (or whose `group` is) is dropped after matching, so what it used up stays used. `hint` is a cheaper
    pattern that any kept match has; texts without it are not cut.
    """
    rx, number = _literal(pattern), KINDS.index(kind)
    found = f"regexp_extract_all(_text, {rx}, 0)"
    size = f"length(regexp_extract(x.m, {rx}, {group}))" if group else "length(x.m)"
    value = f"regexp_extract(x.m, {_literal(VALUES[kind][0])}, {VALUES[kind][1]})" if kind in VALUES else "x.m"
    begin, end = "a.at + length(x.g)", "a.at + length(x.g) + length(x.m)"
    step = f"named_struct('start', {begin}, 'kind', {number}, 'stop', if({size} >= {least}, {end}, -1), 'value', {value})"  # -1: to be dropped
    part = f"""aggregate(slice(p, {CHUNK} * c + 1, {CHUNK}), named_struct('at', b.at, 'out', cast(array() as {_SPANS})),
        (a, x) -> named_struct('at', {end}, 'out', concat(a.out, array({step}))))"""
    walk = f"""
      transform(array(zip_with(slice(split(_text, {rx}, -1), 1, size({found})), {found}, (g, m) -> named_struct('g', g, 'm', m))), p ->
        filter(flatten(aggregate(sequence(0, (size(p) - 1) div {CHUNK}), named_struct('at', 0, 'out', cast(array() as array<{_SPANS}>)),
          (b, c) -> transform(array({part}), r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out))))[0]).out),
          x -> x.stop > x.start))[0]"""
    return F.expr(f"case when _text rlike {_literal(hint or pattern)} then {walk} else cast(array() as {_SPANS}) end")


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, and the arrays assign, access, hex, extra of every row of `docs` (text null: empty)."""
    lean = docs.select("doc_id", *keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.col("text").isNull().alias("_null"))
    some = "(" + "|".join(EXTRA.values()) + ")"
    extra = F.when(F.col("_text").rlike(some), F.concat(*[matches(k, p, 1) for k, p in EXTRA.items()])).otherwise(F.expr(f"cast(array() as {_SPANS})"))
    return lean.select(
        "doc_id", *keep,
        matches("assign", ASSIGN, 12, group=2, hint=r"""([Ww][Oo][Rr][Dd]|[Ss][Ww][Dd]|[Cc][Rr][Ee][Tt]|[Kk][Ee][Nn]|[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""").alias("assign"),
        # A run is matched whole, so "long enough" can be asked while matching.
        matches("access", ACCESS[:-1] + "{14,}+", 18).alias("access"),
        matches("hex", HEX[:-1] + "{16,}+", 16).alias("hex"),
        extra.alias("extra"),
        "_text", "_null",
    )


def ownership(candidates: DataFrame, wide: int = WIDE_OWNERS, repos: int = WIDE_REPOS) -> DataFrame:
    """(hash, n_repos, n_owners, n_places, status) of (hash, repo, owner) rows, one for each place.

    Distinct pairs are folded in three pre-aggregated steps, so a value that a third of all places hold arrives
    as one row from each task. Status: `example` if at least `wide` owners hold the value, or at least two owners
    in at least `repos` repositories, else `live`: many repositories of one owner are still that owner's. Null
    repositories and owners count as one each.
    """
    pairs = candidates.groupBy("hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    out = owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_places"))
    copied = (F.col("n_owners") >= wide) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= repos))
    return out.withColumn("status", F.when(copied, "example").otherwise("live"))


def joined(spans: str) -> str:
    """SQL: an array of spans as kind:start:end by start, then kind, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort(transform({spans}, x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop))), x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.stop)), ',')"


def judged(scanned: DataFrame, repo: Column, owner: Column, wide: int = WIDE_OWNERS, keep_text: bool = False) -> DataFrame:
    """Adds `live`, the spans whose values are live-looking, base kinds and extra kinds alike, and the largest
    n_owners and n_repos of the row's values (0 without spans).

    The scan is written once, with the values' hashes, as three steps read it. Only rows that have spans are
    exploded, judged by ownership() and gathered again by row; the others pass by without a shuffle. The number of a
    row is that of the written table, so repeated rows are rows of their own.
    """
    s = scanned.withColumn("_all", F.expr(f"transform(concat(assign, access, hex, extra), x -> named_struct('x', x, 'hash', sha2(x.value, 256)))"))
    if not keep_text:
        s = s.drop("_text")
    s = materialise(s.withColumn("_row", F.monotonically_increasing_id()), "spans")
    places = s.where(F.size("_all") > 0).select("_row", repo.alias("repo"), owner.alias("owner"), F.explode("_all").alias("e")).select("_row", "repo", "owner", "e.x", "e.hash")
    status = ownership(places.select("hash", "repo", "owner"), wide)
    per = places.join(status.select("hash", "status", "n_owners", "n_repos"), "hash").groupBy("_row")
    per = per.agg(F.collect_set(F.when(F.col("status") == "live", F.col("x"))).alias("live"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    none = [F.expr(f"cast(array() as {_SPANS})").alias("live"), F.lit(0).cast("long").alias("n_owners"), F.lit(0).cast("long").alias("n_repos")]
    found = s.where(F.size("_all") > 0).join(per, "_row")
    clean = s.where(F.size("_all") == 0).select("*", *none)
    return found.unionByName(clean).drop("_all", "_row")


def secrets_digest(docs: DataFrame, wide: int = WIDE_OWNERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_owners, n_repos for every row of `docs`.

    The owner of a document is its source, its repository the source and language. `spans` has every base span
    and, of the extra kinds, those that ownership calls live. n_owners and n_repos are the largest of the row's
    values. Null and empty texts have none; repeated rows stay.
    """
    lean = scan(docs.select("doc_id", "text", "source", "lang"), ("source", "lang"))
    j = judged(lean, F.concat_ws("/", F.coalesce("source", F.lit("\0")), F.coalesce("lang", F.lit("\0"))), F.col("source"), wide)
    base = "concat(assign, access, hex)"
    return j.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
        F.expr(joined(f"concat({base}, filter(live, x -> x.kind > 2))")).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_owners", "n_repos",
    )


def redact(docs: DataFrame, wide: int = WIDE_OWNERS, mark: str = "[secret]") -> DataFrame:
    """`docs` with each live span replaced by `mark` and n_chars set anew; nothing else changes, no row goes.

    Overlapping spans are cut once, from the first start to the last end.
    """
    cols = docs.columns
    # Other columns travel under names of their own, as theirs may clash with those in here.
    rest = {c: f"_keep_{c}" for c in cols if c not in ("doc_id", "text")}
    lean = docs.select("doc_id", "text", *[F.col(c).alias(k) for c, k in rest.items()])
    source, lang = (F.coalesce(F.col(rest[c]), F.lit("\0")) for c in ("source", "lang"))
    j = judged(scan(lean, tuple(rest.values())), F.concat_ws("/", source, lang), source, wide, keep_text=True)
    spans = "array_sort(transform(live, x -> named_struct('start', x.start, 'stop', x.stop)))"
    cut = f"""aggregate({spans}, named_struct('at', 0, 'out', cast('' as string)),
      (a, x) -> case when x.start >= a.at
        then named_struct('at', x.stop, 'out', concat(a.out, substring(_text, a.at + 1, x.start - a.at), {_literal(mark)}))
        else named_struct('at', greatest(a.at, x.stop), 'out', a.out) end,
      a -> concat(a.out, substring(_text, a.at + 1)))"""
    text = F.expr(f"case when _null then null when size(live) = 0 then _text else {cut} end")
    out = {c: F.col(rest[c]) if c in rest else F.col(c) for c in cols} | {"text": text}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.size("live") > 0, F.length(text).cast("long")).otherwise(F.col(rest["n_chars"]))
    return j.select(*[c.alias(name) for name, c in out.items()])
