"""Line dedup [native]: a line goes if an earlier line equals it, or lies within ``max_edits`` (0 or 1) of it.

Method: deletion neighbourhoods. Two different lines are within one edit if and only if, over code points,
they give the same string after one deletion at the same place (a substitution), or one is the other after
one deletion. So each line emits hashed keys of its deletion variants, equal keys join, the earliest line of
a key is the partner of the others, ``levenshtein`` verifies, and the earliest line stays. A key's group is
reduced to its earliest line by a map-side aggregate: no pairs inside a group are made, whatever its size.

Variants of all lines would be as many as characters. They are emitted only where they can meet:
  1. equal lines are reduced to one (aggregate on two hashes and the length);
  2. a line emits keys of its first and of its second half (the edit lies in only one of them), and only
     lines that share a half with a different line go on;
  3. these emit, for each block of 64 code points, the hash of all but that block; only blocks
     whose key is shared by different lines go on;
  4. only these blocks emit deletion variants, each hashed with the key of what surrounds the block.
Each step is lossless for one edit: halves and blocks are cut both for the line's own length and for a
partner one shorter, so that an insertion moves no border.

Defined results: lines are compared after ASCII white space is collapsed and trimmed. Blank lines stay and match
nothing. Equal lines go whatever their length; lines of fewer than ``min_chars`` code points go only if equal, as one edit
makes another word of them. "Earlier" is by
(doc_id, row, line number), null doc_id first; rows with equal doc_id and equal text count as one and keep the
same lines. Null text stays null with no lines; an empty text has one empty line. All columns of the input
are returned, with ``text`` cleaned, and three more: n_lines, removed_lines (array of line numbers from 0) and
emptied (true if the text lost all its lines to earlier ones); an input column of these names is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import small, staged

BLOCK = 64
#: Rows of 64 bytes up to which the lines that repeat are sent to all executors (64 MB); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000


def _collapsed(raw: str) -> Column:
    """``raw`` with white space collapsed and trimmed; the regular expression runs only where there is something to collapse."""
    c = F.col(raw)
    odd = c.contains("  ") | c.contains("\t") | c.contains("\x0b") | c.contains("\x0c") | c.contains("\r")
    return F.trim(F.when(odd, F.regexp_replace(c, "[\\x20\\x09-\\x0D]+", " ")).otherwise(c))


def _line_rows(docs: DataFrame) -> DataFrame:
    """did, rk, no, line (white space collapsed) and len for each line of (did, txt)."""
    raw = docs.where(F.col("txt").isNotNull()).select("did", F.xxhash64("did", "txt").alias("rk"), F.posexplode(F.split("txt", "\n")).alias("no", "raw"))
    return raw.select("did", "rk", "no", _collapsed("raw").alias("line")).withColumn("len", F.length("line"))


def _half_keys() -> Column:
    """Keys of the halves of ``line``, for lines as long as it and for the pair with one shorter."""

    def of(n: Column) -> list[Column]:
        h = F.floor(n / 2).cast("int")
        return [F.xxhash64(n, F.lit(0), F.substr("line", F.lit(1), h)), F.xxhash64(n, F.lit(1), F.right(F.col("line"), n - h))]

    return F.array(*of(F.col("len")), *of(F.col("len") - 1))


def _shared(keys: DataFrame, by: str, who: str) -> DataFrame:
    """The values of ``by`` that different values of ``who`` have."""
    return keys.groupBy(by).agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select(by)


def _near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, len, near) with the earliest line within one edit of a distinct line, if one is earlier."""
    keys = lines.select("h1", F.explode("keys").alias("key"))
    meets = keys.join(_shared(keys, "key", "h1"), "key").select("h1").distinct()
    found = staged(lines.join(meets, "h1", "left_semi").select("h1", "h2", "len", "first"), "line-halves")
    ids = small(staged(found.select(F.col("first.did").alias("did"), F.col("first.rk").alias("rk")).distinct(), "line-ids"), BROADCAST_ROWS)
    hashed = docs.where(F.col("txt").isNotNull()).withColumn("rk", F.xxhash64("did", "txt"))
    texts = _line_rows(hashed.join(ids.select("rk"), "rk", "left_semi").select("did", "txt")).dropDuplicates(["rk", "no"])
    found = found.select("h1", "h2", "len", "first", F.col("first.rk").alias("rk"), F.col("first.no").alias("no"))
    some = staged(found.join(texts.select("rk", "no", "line"), ["rk", "no"]).drop("rk", "no"), "line-texts")

    # all but one block, for lines of n and n + 1 code points
    sized = some.select("h1", "first", "line", "len", F.explode(F.array(F.col("len"), F.col("len") - 1)).alias("n"))
    cut = sized.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)))
    before = F.col("b") * BLOCK
    after = F.greatest(F.lit(0), F.col("n") - (F.col("b") + 1) * BLOCK)
    cut = cut.select(
        "h1", "first", "n", (F.col("len") > F.col("n")).alias("longer"),
        F.xxhash64("n", "b", F.substr("line", F.lit(1), before), F.right(F.col("line"), after)).alias("around"),
        F.substr("line", before + 1, F.col("len") - before - after).alias("part"),
    )
    cut = cut.join(_shared(cut, "around", "h1"), "around")

    # deletion variants of the block; role 0: the shorter line itself, 1: a longer one less a code point, 2: less one at place p
    gaps = F.sequence(F.lit(1), F.length("part"))
    less = cut.where(F.length("part") > 0).select("h1", "first", "n", "longer", "around", "part", F.explode(gaps).alias("p"))
    less = less.select(
        "h1", "first", F.when(F.col("longer"), 1).otherwise(2).alias("role"),
        F.xxhash64("around", F.when(~F.col("longer"), F.col("p")).otherwise(0), F.concat(F.substr("part", F.lit(1), F.col("p") - 1), F.substr("part", F.col("p") + 1, F.length("part")))).alias("v"),
    )
    own = cut.where(~F.col("longer")).select("h1", "first", F.lit(0).alias("role"), F.xxhash64("around", F.lit(0), "part").alias("v"))
    variants = staged(own.unionByName(less), "line-variants")
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "h1")))
    groups = variants.groupBy("v").agg(earliest(0).alias("m0"), earliest(1).alias("m1"), earliest(2).alias("m2"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi")
    partner = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    pairs = variants.join(groups, "v").withColumn("partner", partner).where("partner.first < first").select("h1", F.col("partner.h1").alias("to")).distinct()

    # verify
    left = some.select("h1", "h2", "len", F.col("line").alias("x"))
    right = some.select(F.col("h1").alias("to"), F.col("first").alias("near"), F.col("line").alias("y"))
    sure = pairs.join(left, "h1").join(right, "to").where(F.levenshtein("x", "y", 1).between(0, 1))
    return sure.groupBy("h1", "h2", "len").agg(F.min("near").alias("near"))


def _unused(name: str, columns: list[str]) -> str:
    """``name``, longer by underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 30, max_edits: int = 1) -> DataFrame:
    """``docs`` with each text less its lines that repeat an earlier line; see the module's docstring."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    spare = {"n_lines", "removed_lines", "emptied"}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in spare])
    all_lines, gone_rk, gone_did, gone_lines = (_unused(c, docs.columns) for c in ("all_lines", "gone_rk", "gone_did", "gone_lines"))
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    plain = docs.select(id_.alias("did"), text.cast("string").alias("txt"))
    lines = _line_rows(plain)  # blank ones, too: a filter here would go below the projection and compute each line twice
    keys = _half_keys() if max_edits else F.array().cast("array<bigint>")
    lines = lines.select("did", "rk", "no", "len", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), keys.alias("keys"))
    distinct = lines.groupBy("h1", "h2", "len").agg(F.min(F.struct("did", "rk", "no")).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    distinct = staged(distinct, "lines")
    best = distinct.select("h1", "h2", "len", "first", "times")
    if max_edits:
        near = staged(_near(plain, distinct.where(F.col("len") >= max(min_chars, 2))), "lines-near")
        best = best.join(near, ["h1", "h2", "len"], "left").select("h1", "h2", "len", F.least("first", F.coalesce("near", "first")).alias("first"), "times", F.col("near").isNotNull().alias("is_near"))
    else:
        best = best.withColumn("is_near", F.lit(False))
    best = small(staged(best.where("len > 0 and (times > 1 or is_near)").select("h1", "h2", "len", "first"), "lines-again"), BROADCAST_ROWS)
    gone = lines.join(best, ["h1", "h2", "len"]).where(F.struct("did", "rk", "no") > F.col("first"))
    gone = gone.groupBy("rk", "did").agg(F.sort_array(F.collect_set("no")).alias("gone_lines"))
    gone = gone.select(F.col("rk").alias(gone_rk), F.col("did").alias(gone_did), F.col("gone_lines").alias(gone_lines))

    row = _unused("row_key", docs.columns)
    whole = docs.withColumns({row: F.when(text.isNotNull(), F.xxhash64(id_, text.cast("string"))), all_lines: F.split(text, "\n")}).drop(text_col)
    joined = whole.join(gone, (F.col(row) == F.col(gone_rk)) & id_.eqNullSafe(F.col(gone_did)), "left")
    n = F.size(all_lines)
    edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col(gone_lines)).alias("a"), F.concat(F.col(gone_lines), F.array(n)).alias("b"))
    left = F.flatten(F.transform(edges, lambda e: F.slice(all_lines, e["a"] + 2, e["b"] - e["a"] - 1)))
    out = joined.withColumns(
        {
            text_col: F.when(F.col(gone_lines).isNull(), F.array_join(all_lines, "\n")).otherwise(F.array_join(left, "\n")),
            "n_lines": F.when(F.col(all_lines).isNotNull(), n),
            "removed_lines": F.coalesce(gone_lines, F.array().cast("array<int>")),
            "emptied": F.coalesce(F.col(gone_lines).isNotNull() & ~F.exists(left, lambda x: F.trim(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " ")) != ""), F.lit(False)),
        }
    )
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "n_lines", "removed_lines", "emptied")
