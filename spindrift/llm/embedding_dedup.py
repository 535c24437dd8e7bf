"""Near-duplicate vectors: ITQ codes, multi-index Hamming tables, and a rerank with the original vectors.

Equal vectors of a label are one class. Codes are of directions (vectors scaled to length 1), as links are by cosine,
and so is the sample that they are fitted on. A class's code is cut into substrings of 16 bits; each is a table. A
class enters, in every table, under its substring and under those with one of its ``probes`` least certain
bits flipped; two classes whose codes are near meet under some key. Keys with one class fall away before any
vector moves. Under a key, vectors are compared in blocks by their cosines in double precision; a key with
more classes than a block gives pairs of blocks, each its own piece of work. A pair that meets under several
keys counts under the first of them only, so sums of links are exact without listing pairs; a block reports
each class's number of links and a spanning forest.

Links are never reported below the threshold. Found are all that meet under a key: those whose codes differ
in fewer bits than there are tables always do.

Defined cases: a null label, and a vector that is null, empty, zero, has null or non-finite parts, or a length
other than most of the fitted sample, links with nothing and is its own component; a repeated row is another
vector; a null id is never the smallest of a component with other ids; an empty table gives an empty result;
other columns pass through; those named like new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import itq
from spindrift.llm._store import materialise
from spindrift.llm.components import connected_components
from spindrift.llm.simhash import _forest

#: Bits of a table's substring, and classes of one key that are compared in one block.
SUBSTRING, BLOCK = 16, 512


def table_keys(projected: np.ndarray, probes: int) -> np.ndarray:
    """(n, tables * (1 + probes)) keys: a table's number and a substring value; a row's own come first, table by table."""
    n, bits = projected.shape
    columns, flipped = [], []
    for t, at in enumerate(range(0, bits, SUBSTRING)):
        part = projected[:, at : at + SUBSTRING]
        value = (part > 0) @ (1 << np.arange(part.shape[1]))
        columns.append((t << SUBSTRING | value)[:, None])
        least = np.argsort(np.abs(part), axis=1, kind="stable")[:, :probes]
        flipped.append(t << SUBSTRING | (value[:, None] ^ (1 << least)))
    return np.concatenate(columns + flipped, axis=1).astype(np.int64)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that rows a[i] and b[i] of keys have in common."""
    best = np.full(len(a), np.iinfo(np.int64).max)
    for c in range(a.shape[1]):
        shared = (a[:, c : c + 1] == b).any(axis=1)
        best = np.where(shared, np.minimum(best, a[:, c]), best)
    return best


def _compare(batches: Iterator[pa.RecordBatch], model: itq.Itq, probes: int, least: float) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group. Out: (cid, other, weight): a number of links where other is null, else an edge."""
    schema = pa.schema([("cid", pa.int64()), ("other", pa.int64()), ("weight", pa.int64())])

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, left, right = (rows.column(c)[0].as_py() for c in ("key", "left", "right"))
        own, cid, n = (rows.column(c).to_numpy() for c in ("own", "cid", "n"))
        x = unit = itq.unit(itq.matrix(rows.column("vector").combine_chunks()))
        keys = table_keys(model.project(unit), probes)
        a, b = (np.flatnonzero(own == left), np.flatnonzero(own == right)) if left != right else (np.arange(len(x)),) * 2
        i, j = np.nonzero(unit[a] @ unit[b].T >= least)
        i, j = a[i], b[j]
        i, j = (i[i < j], j[i < j]) if left == right else (i, j)
        links = np.zeros(len(x), dtype=np.int64)
        kept_i, kept_j = [], []
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            first = _first_shared(keys[p], keys[q]) == key
            p, q = p[first], q[first]
            links += np.bincount(p, n[q], len(x)).astype(np.int64) + np.bincount(q, n[p], len(x)).astype(np.int64)
            kept_i.append(p)
            kept_j.append(q)
        if not kept_i:
            return
        child, root = _forest(len(x), np.concatenate(kept_i), np.concatenate(kept_j))
        linked = np.flatnonzero(links)
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked])], schema=schema)
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(cid[child]), pa.array(cid[root]), pa.nulls(len(child), pa.int64())], schema=schema)

    rest: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        spot = np.stack([rows.column(c).to_numpy() for c in ("group", "key", "left", "right")])
        cuts = [0, *(np.flatnonzero((spot[:, 1:] != spot[:, :-1]).any(axis=0)) + 1).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield from block(rows.slice(s, e - s))
        rest = rows.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield from block(rest)


def embedding_near_dedup(vectors: DataFrame, least: float = 0.98, probes: int = 3, block: int = BLOCK, sample: int = itq.SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Adds n_links (long), component_id (of the id's type) and kept (boolean) to ``vectors``."""
    vectors = vectors.drop("n_links", "component_id", "kept")
    marked = vectors.withColumns({"_ok": itq.usable(F.col(vector_col)) & F.col(label_col).isNotNull(), "_h1": F.xxhash64(F.lit(1), vector_col), "_h2": F.xxhash64(F.lit(2), vector_col)})
    same = [F.col(label_col).alias("label"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2")]
    classes = marked.where("_ok").groupBy(*same).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"), F.first(vector_col).alias("vector"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    model = itq.fit_table(classes, "h1", "vector", sample=sample, scaled=True)
    alone = vectors.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col(id_col), "kept": F.lit(True)})
    if model is None:
        return alone
    classes = classes.where(F.size("vector") == len(model.mean))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                keys = table_keys(model.project(itq.unit(itq.matrix(part.column(1)))), probes)
                rows = np.repeat(np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(keys.reshape(-1))], ["cid", "label", "key"])

    kind = classes.schema["label"].dataType.simpleString()
    keyed = materialise(classes.select("cid", "vector", "label").mapInArrow(keys_of, f"cid long, label {kind}, key long"), "keyed")
    shared = materialise(keyed.groupBy("label", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "shared")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("left"), F.greatest(F.col("own"), other).alias("right")))
    met = keyed.join(shared, ["label", "key"]).withColumn("own", own).withColumn("pair", F.explode(pairs)).select("cid", "label", "key", "own", "pair.left", "pair.right")
    met = met.join(classes.select("cid", "n", "vector"), "cid")
    # Labels may be of any type: a hash stands for them, beside the key and the block numbers.
    spot = ["label", "key", "left", "right"]
    met = met.withColumn("group", F.xxhash64(*spot))
    found = materialise(met.repartition(*spot).sortWithinPartitions("group", *spot).select("group", "key", "left", "right", "own", "cid", "n", "vector").mapInArrow(lambda it: _compare(it, model, probes, least), "cid long, other long, weight long"), "found")

    links = found.where("other IS NULL").groupBy("cid").agg(F.sum("weight").alias("links"))
    component = connected_components(found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    grouped = classes.select("cid", "label", "h1", "h2", "first", "n").join(links, "cid", "left").join(component.withColumnRenamed("node", "cid"), "cid", "left")
    grouped = materialise(grouped.select("label", "h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("of")), "grouped")
    firsts = materialise(grouped.groupBy("of").agg(F.min("first").alias("component_id")), "firsts")
    of_class = materialise(grouped.join(firsts, "of").select(F.col("label").alias("_label"), F.col("h1").alias("_of1"), F.col("h2").alias("_of2"), F.col("n_links").alias("_links"), F.col("component_id").alias("_component")), "of_class")
    on = (marked[label_col] == of_class["_label"]) & (marked["_h1"] == of_class["_of1"]) & (marked["_h2"] == of_class["_of2"]) & marked["_ok"]
    out = marked.join(of_class, on, "left").withColumns({"n_links": F.coalesce("_links", F.lit(0)).cast("long"), "component_id": F.coalesce("_component", id_col)})
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))).select(*vectors.columns, "n_links", "component_id", "kept")
