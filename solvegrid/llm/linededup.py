"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines are split at line feeds and compared without the ASCII white space around them; blank
lines take no part and stay. A run of at least ``gram + window - 1`` lines is guaranteed to be
found: each window of that many lines selects the smallest hash of its ``gram``-line pieces
(the last among equals) as its fingerprint, and equal windows select equal fingerprints.

1. Occurrences of fingerprints are counted; those that occur once are dropped.
2. The positions of the windows that selected the others are joined with the first position
   of the same lines (smallest id, then place). That one is found by a partial aggregation, so
   no pair of later occurrences is made.
3. A pair of positions is extended both ways: matches that lie next to each other at the same
   distance in the same source are one match, (place, source, source's place, lines), as long
   as it gets. What isn't the source's own place is a later repeated run and is cut.

A window is told apart by the 64-bit hashes of all its lines.

With ``alone`` a line of that many words or more is a run by itself: its later occurrences go
whatever their neighbours are, in documents of one line too. With None a repeated line between
different neighbours stays, and so does a copied one-line document.

Cases: null text has no lines and stays null; a text all of whose lines go keeps its blank
lines; an empty table gives no rows; lines and texts of any length are compared whole; rows
that share id and text are one place, so none is earlier than the other, rows that share the
id only are told apart by a hash of their text; a null id counts as the smallest; other columns
and their names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

GRAM = 1
WINDOW = 2
#: Words that make a single line evidence of a copy; shorter ones need a neighbour.
ALONE = 20
_WS = " \t\r\x0b\x0c"


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.coalesce(F.xxhash64(text_col), F.lit(0))


def _zip(arrays: list[Column], names: list[str]) -> Column:
    """An array of structs of equally long arrays."""
    kind = ",".join(f"{n}:bigint" for n in names)
    return F.arrays_zip(*arrays).cast(f"array<struct<{kind}>>")


def _lines(text_col: str) -> Column:
    """Trimmed lines that aren't blank, s, and their numbers in the text, i."""
    trimmed = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(_WS)).alias("s"), i.cast("long").alias("i")))
    return F.filter(trimmed, lambda x: x["s"] != "")


def windows(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, fingerprint, fresh, k0..., j, a, b: a row for each window of lines.

    fresh marks the first window of each occurrence of a fingerprint; k are the lines' hashes,
    j is the window's number, a and b are the numbers of its first and last line in the text.
    """
    span = gram + window - 1
    place, tag = _key(id_col, text_col)
    lines = F.transform(_lines(text_col), lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), x["i"].alias("i")))
    base = docs.select(place.alias("id"), tag.alias("tag"), lines.alias("lines")).where(F.size("lines") >= span)
    base = base.select("id", "tag", F.col("lines.h").alias("h"), F.col("lines.i").alias("i"), F.size("lines").alias("n"))

    def shifted(name: str, by: int, length: Column) -> Column:
        return F.slice(F.col(name), F.lit(by + 1), length)

    if gram > 1:
        pieces = _zip([shifted("h", j, F.col("n") - (gram - 1)) for j in range(gram)], [f"x{j}" for j in range(gram)])
        base = base.withColumn("g", F.transform(pieces, lambda x: F.xxhash64(x)))
    else:
        base = base.withColumn("g", F.col("h"))
    count = F.col("n") - (span - 1)
    # smallest hash, then the last place: places count downwards
    base = base.withColumn("m", F.transform("g", lambda x, j: F.struct(x.alias("h"), (-j).cast("long").alias("p"))))
    if window > 1:
        best = F.arrays_zip(*[shifted("m", j, count) for j in range(window)])
        base = base.withColumn("b", F.transform(best, lambda x: F.array_min(F.array(*[x[str(j)] for j in range(window)]))))
    else:
        base = base.withColumn("b", F.col("m"))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.col("b.p"), F.lit(1), count - 1))
    names = ["fingerprint", "p", "q", *[f"k{j}" for j in range(span)], "j", "a", "b"]
    parts = [F.col("b.h"), F.col("b.p"), before, *[shifted("h", j, count) for j in range(span)], F.sequence(F.lit(0), count - 1), shifted("i", 0, count), shifted("i", span - 1, count)]
    rows = base.select("id", "tag", F.inline(_zip(parts, names)))
    return rows.withColumn("fresh", ~F.col("p").eqNullSafe(F.col("q"))).drop("p", "q")


def single(docs: DataFrame, alone: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, i: the later occurrences of lines of alone words or more."""
    place, tag = _key(id_col, text_col)
    # words are counted only in lines that have room for so many
    long = F.filter(_lines(text_col), lambda x: (F.length(x["s"]) >= 2 * alone - 1) & (F.regexp_count(x["s"], F.lit(C.WORD)) >= alone))
    rows = docs.select(place.alias("id"), tag.alias("tag"), F.inline(F.transform(long, lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), x["i"].alias("i")))))
    # written, so that the join can split a very common line
    rows = C.settle(rows)
    lead = C.settle(rows.groupBy("h").agg(F.min(F.struct("id", "i")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.col("lead.id").alias("lead_id"), F.col("lead.i").alias("lead_i")))
    return rows.join(lead, "h").where(F.struct("id", "i") > F.struct("lead_id", "lead_i")).select("id", "tag", "i")


def matches(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, j, source, source_j, n_lines, a, b: each later repeated run with where it was first.

    j and source_j count the lines that aren't blank; a and b are the numbers of the first and
    the last line in the text.
    """
    span = gram + window - 1
    keys = [f"k{j}" for j in range(span)]
    rows = windows(docs, gram=gram, window=window, id_col=id_col, text_col=text_col)
    # written, so that the joins deal both sides themselves and can split a very common line
    again = C.settle(rows.where("fresh").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    found = C.settle(rows.join(again, "fingerprint", "left_semi").drop("fingerprint", "fresh"))
    lead = found.groupBy(*keys).agg(F.min(F.struct("id", "j")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.col("lead.id").alias("source"), F.col("lead.j").alias("source_j"))
    pairs = found.join(C.settle(lead), keys).where(F.struct("id", "j") > F.struct("source", "source_j"))
    pairs = pairs.select("id", "tag", "source", (F.col("source_j") - F.col("j")).alias("shift"), "j", "a", "b")
    # neighbours at one distance have the same difference between their number and their rank
    order = Window.partitionBy("id", "tag", "source", "shift").orderBy("j")
    runs = pairs.withColumn("run", F.col("j") - F.row_number().over(order)).groupBy("id", "tag", "source", "shift", "run")
    runs = runs.agg(F.min("j").alias("j"), (F.max("j") - F.min("j") + span).alias("n_lines"), F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.select("id", "tag", "j", "source", (F.col("j") + F.col("shift")).alias("source_j"), "n_lines", "a", "b")


def repeats(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, alone: int | None = ALONE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, ranges: the ranges of line numbers whose lines go, in order and apart, for documents that have any."""
    gone = matches(docs, gram=gram, window=window, id_col=id_col, text_col=text_col).select("id", "tag", "a", "b")
    if alone is not None:
        gone = gone.unionByName(single(docs, alone, id_col=id_col, text_col=text_col).select("id", "tag", F.col("i").alias("a"), F.col("i").alias("b")))
    order = Window.partitionBy("id", "tag").orderBy("a", "b")
    # a range that starts beyond all before it begins a part of its own
    begins = F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    parts = gone.withColumn("begins", begins.cast("long")).withColumn("part", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.groupBy("id", "tag", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return C.settle(parts.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges")))


def _full(lines: Column) -> Column:
    """How many lines aren't blank; 0 for null."""
    return F.greatest(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_WS)) != "")), F.lit(0)).cast("long")


def _cut(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' columns as c0..., with __lines, __ranges and __left, the lines that stay; all null where nothing goes."""
    place, tag = _key(id_col, text_col)
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], place.alias("__id"), tag.alias("__tag"))
    text = F.col(f"c{docs.columns.index(text_col)}")
    # the same join at every size: the ranges grow as the texts do
    joined = own.join(found.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("ranges").alias("__ranges")).hint("merge"), ["__id", "__tag"], "left")
    joined = joined.withColumn("__lines", F.when(F.col("__ranges").isNotNull(), F.split(text, "\n", -1)))
    lines, size = F.col("__lines"), F.size("__lines").cast("long")
    # what lies before each range, and the blank lines in it; the last piece has an empty range
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__ranges", lambda r: r["b"] + 1))
    a, b = F.concat(F.transform("__ranges", lambda r: r["a"]), F.array(size)), F.concat(F.transform("__ranges", lambda r: r["b"]), F.array(size - 1))

    def kept(z: Column) -> Column:
        within = F.slice(lines, (z["a"] + 1).cast("int"), (z["b"] - z["a"] + 1).cast("int"))
        return F.concat(F.slice(lines, (z["s"] + 1).cast("int"), (z["a"] - z["s"]).cast("int")), F.filter(within, lambda x: F.btrim(x, F.lit(_WS)) == ""))

    return joined.withColumn("__left", F.flatten(F.transform(_zip([starts, a, b], ["s", "a", "b"]), kept)))


def dedup(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, alone: int | None = ALONE, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the later repeated runs cut from their texts; length_col, if given, is brought up to date."""
    found = repeats(docs, gram=gram, window=window, alone=alone, id_col=id_col, text_col=text_col)
    joined = _cut(docs, found, id_col, text_col)
    left = F.array_join("__left", "\n")

    def column(i: int, c: str) -> Column:
        own = F.col(f"c{i}")
        if c == text_col:
            return F.when(F.col("__ranges").isNull(), own).otherwise(left).alias(c)
        if c == length_col:
            return F.when(F.col("__ranges").isNull(), own).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c)
        return own.alias(c)

    return joined.select(*[column(i, c) for i, c in enumerate(docs.columns)])


def digests(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, alone: int | None = ALONE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = repeats(slim, gram=gram, window=window, alone=alone)
    joined = _cut(slim, found, "doc_id", "text").withColumn("__full", _full(F.split("c1", "\n", -1)))
    removed = F.when(F.col("__ranges").isNull(), F.lit(0)).otherwise(F.col("__full") - _full(F.col("__left"))).cast("long")
    kept = F.when(F.col("__ranges").isNull(), F.coalesce("c1", F.lit(""))).otherwise(F.array_join("__left", "\n"))
    return joined.select(F.col("c0").alias("doc_id"), F.col("__full").alias("n_lines"), removed.alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL over the table documents with the default parameters: runs of two lines or more, and lines of 20 words or more.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
t AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM l),
w AS (SELECT doc_id, i AS i0, s AS s0, lead(i) OVER d AS i1, lead(s) OVER d AS s1 FROM t WHERE s <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, min((doc_id, i0)) OVER (PARTITION BY s0, s1) AS lead FROM w WHERE s1 IS NOT NULL),
o AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY s) AS lead FROM t WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (SELECT doc_id, i0 AS i FROM f WHERE (doc_id, i0) > lead UNION SELECT doc_id, i1 FROM f WHERE (doc_id, i0) > lead UNION SELECT doc_id, i FROM o WHERE (doc_id, i) > lead),
kept AS (
  SELECT t.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN t.line END, chr(10) ORDER BY t.i) AS kept, count(*) FILTER (s <> '') AS n_lines, count(gone.i) AS n_removed
  FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
