"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, linked at 2 or fewer differing bits.

Candidates come from an inverted index over positional bytes. Two differing bits spoil at most two of the eight bytes, so a
linked pair shares at least six positional bytes, the guaranteed minimum. Lists of a single byte would hold 1/256 of all
fingerprints each; a posting here is four positional bytes, and the fourteen quadruples used are a Steiner system: any three positions lie in
exactly one of them. So the number of lists that two fingerprints share tells how many positional bytes they share: 14, 7 and 3 lists
are eight, seven and six bytes, and fewer bytes share one list at most. Each list emits its pairs, pairs are counted over the lists,
those with three and more are kept (the count filter), and the Hamming distance verifies them.

A list of over ``LONG_LIST`` different fingerprints (very many near copies) makes no pairs. Its fingerprints emit
themselves and their 64 one-bit neighbours instead; all that share such a neighbour are within two bits, and
any two within two bits share one. So they link to the least of at most 65 fingerprints: exact, and linear. A pair
that shares a long list has both its fingerprints there, so the lists it is not counted for lose no link.

Equal fingerprints are one node. Null text counts as empty: fingerprint zero. Repeated rows get a row each; other columns
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.graph import components
from probeforge.llm.runtime import lean_batches, staged
from probeforge.llm.textio import binary_column

SHINGLE = 3
LONG_LIST = 256
MAX_BITS = 2
#: Quadruples of the eight byte positions of which any three positions lie in exactly one (a Steiner system).
QUADRUPLES = tuple(q for q in itertools.combinations(range(8), 4) if not q[0] ^ q[1] ^ q[2] ^ q[3])
#: Lists that two fingerprints share if they share six positional bytes.
MIN_LISTS = 3
_PART = 1 << 15


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _PART):
        some = words[at : at + _PART + SHINGLE - 1]
        h = np.fromiter((digest(join(s), 42) for s in zip(some, some[1:], some[2:])), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, fp bigint) for each row; with ``text_hash`` the text's xxhash64, too, as ``th``."""
    lean_batches(docs.sparkSession)
    extra = [F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th")] if text_hash else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in binary_column(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra).mapInArrow(run, "doc_id bigint, fp bigint" + (", th bigint" if text_hash else ""))


def _postings(fp: str = "fp"):
    """The keys of a fingerprint's lists."""
    byte = [F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for k, places in enumerate(QUADRUPLES):
        key = F.lit(k).cast("bigint")
        for i in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    return F.array(*keys)


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, lists) from postings (fp, key, n): pairs of short lists, with how many of these lists they share."""
    lists = shared.where(f"n <= {LONG_LIST}").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    some = lists.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.greatest(F.lit(0), F.size("fps") - F.col("i") - 1))).alias("b"))
    return some.groupBy("a", "b").agg(F.count("*").alias("lists"))


def posting_lists(fps: DataFrame) -> DataFrame:
    """(key, fp, n) of the lists that more than one of ``fps`` (distinct fp) are in; n: how many."""
    index = fps.select("fp", F.explode(_postings()).alias("key"))
    counted = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return staged(index.join(counted, "key"), "fp-lists")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b) between different fingerprints of ``fps`` (distinct fp) that suffice to connect all within MAX_BITS."""
    shared = posting_lists(fps)
    many = shared.where(f"n > {LONG_LIST}").select("fp").distinct()
    # a pair that meets in a long list is linked by its neighbours below, so a count short of long lists loses nothing
    near = candidate_pairs(shared).where(F.col("lists") >= MIN_LISTS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    met = around.groupBy("v").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b")
    return near.select("a", "b").unionByName(stars.select("a", "b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id: the smallest doc_id reachable over links.

    With ``text_hash`` also th (the text's xxhash64) and root (a fingerprint that only this component has).
    """
    extra = ["root"] if text_hash else []
    marked = staged(fingerprints(docs, id_col, text_col, text_hash), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = components(fingerprint_links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "fp-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(rooted.join(ids, "root").select("fp", "component_id", *extra), "fp-components")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id", *(["th", "root"] if text_hash else []))


def hex_fingerprint(fp: str = "fp"):
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: of least id, then of least text hash; of equal rows, one.

    An id may have several texts in different components; each of these keeps its own row. Rows with a null id
    are each of their own kind and stay.
    """
    marked = simhash_components(docs, id_col, text_col, text_hash=True).where("doc_id = component_id")
    kept = marked.groupBy("root", "doc_id").agg(F.min("th").alias("kept_th")).select(F.col("doc_id").alias("kept_doc_id"), "kept_th").distinct()
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    stay = docs.join(kept, (id_.cast("long") == F.col("kept_doc_id")) & (F.xxhash64(text.cast("string")) == F.col("kept_th")), "left_semi")
    return stay.dropDuplicates([id_col, text_col]).unionByName(docs.where(id_.isNull()))
