"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is the majority of the XXH64 hashes of a text's SHINGLE
words.  Fingerprints link at RADIUS or fewer differing bits.  They are cut into
3 segments, so that of 4 differing bits some segment has one at most.  Each
segment is indexed once for each of its bits, with that bit deleted: two
segments that differ in one bit or none share such a variant.  An equality join
on the variants gives candidates and the distance decides, in the join's own
condition.

Work is on distinct fingerprints, copies being counted first.  In each bucket of
a variant the fingerprint with most copies is its hub (one shuffle of 64 rows a
fingerprint, whose buckets stream and spill).  Members within RADIUS of
the hub are linked to it and not to each other; the others are compared with all
members.  That loses no component: a pair that is left out has both its ends
linked to a hub that is larger, in the order of (copies, fingerprint), than
either; where such a link is left out in turn, a still larger hub stands in.

Rows: texts without words, null ones too, have fingerprint zero and are linked
like others; texts of any length are read whole, each by one task; a bit that is
set in exactly half the hashes is 0; a null doc_id never names a component that
has others; repeated rows give repeated rows; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm.common import hidden, stored
from attesta.llm.components import components

#: Fixed values.
SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 21), (21, 42), (42, 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([digest(p, seed) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, fp): row tells rows with one key and other texts apart."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("row", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=schema.names)

    return docs.select(F.col(key), F.xxhash64(text).alias("row"), F.col(text)).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """(variant, bit, fp, copies): each segment with each of its bits deleted; ``variant`` holds bit and segment."""
    masks, shifts = [], []
    for low, high in SEGMENTS:
        whole = (1 << high) - (1 << low)
        for bit in range(low, high):
            masks.append(_signed(whole & ~(1 << bit)))
            shifts.append(low)
    bit = F.col("bit")
    mask, shift = (F.element_at(F.array(*map(F.lit, xs)), bit + 1) for xs in (masks, shifts))
    rows = fps.select("fp", "copies", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    part = F.call_function("shiftrightunsigned", F.col("fp").bitwiseAND(mask), shift)
    return rows.select((bit.cast("long") * (1 << 22) + part).alias("variant"), "bit", "fp", "copies")


def first_variant(diff: Column) -> Column:
    """The least deleted bit under which two fingerprints with this exclusive or share a variant."""
    out = F.lit(None).cast("int")
    for low, high in reversed(SEGMENTS):
        part = diff.bitwiseAND(F.lit(_signed((1 << high) - (1 << low))))
        # of a single set bit, the number of set bits below it is its place
        place = F.bit_count(part - F.lit(1)) if high < 64 else F.when(part < 0, F.lit(63)).otherwise(F.bit_count(part - F.lit(1)))
        out = F.when(F.bit_count(part) == 0, F.lit(low)).when(F.bit_count(part) == 1, place.cast("int")).otherwise(out)
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them for the right components."""
    all_ = variants(fps)
    bucket = Window.partitionBy("variant")
    tops = all_.withColumns({"top": F.max(F.struct("copies", "fp")).over(bucket), "n": F.count("*").over(bucket)}).filter("n > 1")
    member = tops.select("variant", "bit", "fp", F.col("top.fp").alias("hub"), (F.bit_count(F.col("fp").bitwiseXOR(F.col("top.fp"))) <= radius).alias("near"))
    member = stored(member, "members")
    near = member.filter("near AND fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    far = member.filter("NOT near").select(F.col("variant"), F.col("fp").alias("a"), F.col("bit").alias("at"))
    diff = F.col("a").bitwiseXOR(F.col("fp"))
    holds = (far["variant"] == member["variant"]) & (F.bit_count(diff) <= radius) & (F.col("near") | (F.col("a") < F.col("fp"))) & (F.col("at") == first_variant(diff))
    rest = far.join(member, holds).select("a", F.col("fp").alias("b"))
    return near.unionAll(rest)


def classes(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``marked`` (key, row, fp)."""
    fps = stored(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("copies")), "fingerprints")
    roots = fps.join(components(links(fps)), fps["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    # a fingerprint that is linked to no other names its class itself; the rest meet stored minima, so that Spark can split a large class
    linked = stored(roots.filter("fp <> root").select("root").distinct().withColumn("many", F.lit(True)), "linked")
    roots = stored(roots.join(linked, "root", "left"), "classes")
    least = stored(roots.filter("many").groupBy("root").agg(F.min("least").alias("component_id")), "minima")
    many = roots.filter("many").select("fp", "root").join(least, "root")
    return many.select("fp", "root", "component_id").unionByName(roots.filter("many IS NULL").select("fp", "root", F.col("least").alias("component_id")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    marked = stored(fingerprints(docs, key, text), "marked")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(classes(marked, key), "fp").select(key, digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the least key of each component, its columns as they were."""
    marked = stored(fingerprints(docs, key, text), "marked")
    least = F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "row")).alias("least")
    stay = marked.join(classes(marked, key), "fp").groupBy("root").agg(least).select(F.col("least.key").alias("stay_key"), F.col("least.row").alias("stay_row"))
    row = hidden(docs, "row")
    given = docs.withColumn(row, F.xxhash64(text))
    kept = given.join(stay, given[key].eqNullSafe(F.col("stay_key")) & (given[row] == F.col("stay_row")), "left_semi")
    return kept.dropDuplicates([key, row]).drop(row)
