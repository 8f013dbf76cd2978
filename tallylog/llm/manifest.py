"""A Merkle manifest of a dataset: contiguous digest matrices in aligned blocks, hashed level by level; siblings by index arithmetic.

1. A row's leaf is the SHA-256 (lowercase hex) of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The texts are read once, for that.
2. Leaves are numbered within their group by a range exchange and one running count a partition, so that a group with most of the rows is many partitions.
3. A block is ``fanout ** levels`` leaves in a row, aligned, so that no run of ``fanout`` nodes crosses its edge. A task lays a block's digests out as one matrix of 64 bytes a row, views ``fanout``
   rows as one, hashes these, and so on. The blocks' tops are leaves of the next round, until each group has one node, its subroot; the subroots are then leaves of one more tree.
4. On the way down a block gets the siblings above it and adds its own: those of node i are the bytes of its run before 64 i and from 64 (i + 1), at every level.

A block is the largest thing a task holds (256 kB of digests at 4096 leaves), whatever the input; only the root gets to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, stage_table

FANOUT, LEVELS, WIDTH = 8, 4, 64
#: Rows of a range partition of leaves, about.
PARTITION_ROWS = 250_000


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over the values, each with its length, so that no two rows give the same bytes."""
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in columns]), 256)


def digest_matrix(column) -> np.ndarray:
    """An Arrow column of hex digests as bytes, one row each, without copying them one by one."""
    import pyarrow as pa

    data = column.cast(pa.binary())
    data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
    if isinstance(data, pa.ChunkedArray):
        data = pa.concat_arrays(data.chunks)
    ends = np.frombuffer(data.buffers()[1], "<i4")[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(data), WIDTH)


def tree_levels(leaves: np.ndarray, fanout: int = FANOUT, levels: int | None = None) -> list[np.ndarray]:
    """The matrices of all levels from the leaves up: to a single node, or ``levels`` times if that is given."""
    out = [np.ascontiguousarray(leaves)]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        nodes = out[-1]
        whole = len(nodes) // fanout
        found = [hashlib.sha256(row).hexdigest() for row in nodes[: whole * fanout].reshape(whole, fanout * WIDTH)]
        if len(nodes) > whole * fanout:
            found.append(hashlib.sha256(nodes[whole * fanout :].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(found).encode(), np.uint8).reshape(-1, WIDTH))
    return out


def siblings(levels: list[np.ndarray], fanout: int = FANOUT) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level but the last: what stands left and right of each node in its run."""
    out = []
    for nodes in levels[:-1]:
        data, n = nodes.tobytes(), len(nodes)
        begin = np.arange(n) // fanout * fanout
        end = np.minimum(begin + fanout, n)
        own = np.arange(n)
        out.append(([data[a:b] for a, b in zip((begin * WIDTH).tolist(), (own * WIDTH).tolist(), strict=True)], [data[a:b] for a, b in zip(((own + 1) * WIDTH).tolist(), (end * WIDTH).tolist(), strict=True)]))
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings, level by level, lead to."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _exact(total: int, fanout: int, levels: int) -> int | None:
    """How often a block of a group of ``total`` nodes is hashed; None: until one node is left."""
    return levels if total > fanout**levels else None


def _in_order(table):
    """(rows by place, digests) of a block."""
    order = np.argsort(table.column("_pos").to_numpy(), kind="stable")
    table = table.take(order)
    return table, digest_matrix(table.column("_digest"))


def numbered(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` (with _g, a group's name, never null, and _salt) with _pos, 0 and up by ``order`` within the group, and _total, the group's rows. Rows alike in ``order`` may be dealt to several partitions by _salt."""
    parts = max(8, math.ceil(rows / PARTITION_ROWS))
    keys = ["_g", *[F.col(c).asc_nulls_last() for c in order], "_salt"]
    schema = StructType([*df.schema.fields, StructField("_pid", IntegerType()), StructField("_seq", LongType())])
    names = df.columns

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(names.index("_g"))
            code = group.dictionary_encode().indices.to_numpy()
            start = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            at = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
            if group[0].as_py() == last:
                at[: start[1] if len(start) > 1 else len(at)] += seen
            last, seen = group[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), pid, np.int32)), pa.array(at.astype(np.int64))], [*names, "_pid", "_seq"])

    sorted_ = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = stage_table(sorted_.mapInArrow(run, schema), "numbered")
    counts = held.groupBy("_g", "_pid").agg((F.max("_seq") + 1).alias("_n"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_g", "_pid", before.alias("_before"), F.sum("_n").over(group).alias("_total"))
    return held.join(counts, ["_g", "_pid"]).withColumn("_pos", F.col("_seq") + F.col("_before")).drop("_pid", "_seq", "_before", "_salt")


def _grown(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of (_g, _pos, _total, _digest), each of the tops of the blocks before; the last has one node a group."""

    def climb(table):
        import pyarrow as pa

        table, leaves = _in_order(table)
        total, block = table.column("_total")[0].as_py(), table.column("_block")[0].as_py()
        top = tree_levels(leaves, fanout, _exact(total, fanout, levels))[-1]
        assert len(top) == 1
        return pa.table({"_g": table.column("_g").slice(0, 1), "_pos": pa.array([block], pa.int64()), "_total": pa.array([-(-total // fanout**levels)], pa.int64()), "_digest": [top.tobytes().decode()]})

    rounds = [nodes]
    while True:
        blocks = rounds[-1].select("_g", "_pos", "_total", "_digest", F.floor(F.col("_pos") / fanout**levels).alias("_block"))
        rounds.append(stage_table(blocks.groupBy("_g", "_block").applyInArrow(climb, "_g string, _pos long, _total long, _digest string"), "nodes"))
        if rounds[-1].where("_total > 1").isEmpty():
            return rounds


_PATH = "_g string, _pos long, _left array<string>, _right array<string>, _subroot string"


def _inside(table, above, fanout: int, levels: int):
    """(rows of a block by place, its levels' siblings, the siblings above it, subroot)."""
    table, leaves = _in_order(table)
    own = siblings(tree_levels(leaves, fanout, _exact(table.column("_total")[0].as_py(), fanout, levels)), fanout)
    up = above.to_pylist()[0]
    return table, leaves, own, [(a.encode(), b.encode()) for a, b in zip(up["_left"], up["_right"], strict=True)], up["_subroot"]


def _path(own, above, i: int, fanout: int) -> list[tuple[bytes, bytes]]:
    out = []
    for left, right in own:
        out.append((left[i], right[i]))
        i //= fanout
    return out + above


def _lowered(nodes: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The paths of a round's nodes from those of the round above it."""

    def down(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({"_g": pa.array([], pa.string()), "_pos": pa.array([], pa.int64()), "_left": pa.array([], pa.list_(pa.string())), "_right": pa.array([], pa.list_(pa.string())), "_subroot": pa.array([], pa.string())})
        table, _, own, above, subroot = _inside(left, right, fanout, levels)
        paths = [_path(own, above, i, fanout) for i in range(table.num_rows)]
        return pa.table({"_g": table.column("_g"), "_pos": table.column("_pos"), "_left": pa.array([[a.decode() for a, _ in p] for p in paths], pa.list_(pa.string())), "_right": pa.array([[b.decode() for _, b in p] for p in paths], pa.list_(pa.string())), "_subroot": pa.array([subroot] * len(paths), pa.string())})

    blocks = nodes.select("_g", "_pos", "_total", "_digest", F.floor(F.col("_pos") / fanout**levels).alias("_block"))
    return blocks.groupBy("_g", "_block").cogroup(paths.groupBy("_g", "_pos")).applyInArrow(down, _PATH)


def merkle_manifest(
    df: DataFrame, columns: list[str], group_col: str = "lang", order_col: str = "doc_id", changed: dict[str, Column] | None = None, carry: list[str] | None = None,
    fanout: int = FANOUT, levels: int = LEVELS, with_proof: bool = False,
) -> DataFrame:
    """Every row of ``df`` with its columns ``carry`` (unless given, ``order_col``) and ``leaf``, ``subroot`` (its group's), ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Leaves are over ``columns`` in their order, and ascend by ``order_col`` within ``group_col``; groups by name, the null one first. ``changed`` gives other values for some columns, as somebody
    who altered the data would have: the folded root is computed from the leaf of these and the siblings as they were, so ``verified`` tells whether the row is still what the manifest says.
    ``with_proof`` adds ``proof``: (left, right) for each level up to the root, what stands beside the node there; both are empty where it is alone.
    Values are hashed as text (numbers in decimal). Null orders come last, equal ones by leaf; repeated rows have the same leaf and a place each. An empty table has no rows and no root.
    Names of ``df`` that clash with the new ones stay, and the new ones get leading underscores.
    """
    carry = [order_col] if carry is None else carry
    names = fresh(df.select(*[F.col(f"`{c}`") for c in carry]), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * with_proof)
    changed = changed or {}
    now = [F.col(f"`{c}`") for c in columns]
    other = leaf_digest([changed.get(c, F.col(f"`{c}`")) for c in columns])
    group = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], group.alias("_g"), F.col(f"`{order_col}`").alias("_order"), leaf_digest(now).alias("_digest"),
        (other if changed else F.lit(None).cast("string")).alias("_other"), F.monotonically_increasing_id().alias("_salt"),
    )
    leaves = leaves.withColumn("_other", F.when(F.col("_other") != F.col("_digest"), F.col("_other")))
    leaves = stage_table(leaves, "leaves")
    rows = leaves.count()
    out = [f"c{i}" for i in range(len(carry))]
    texts = [StructField(c, StringType()) for c in ("_digest", "_subroot", "_root", "_proof", "_folded")]
    lists = [StructField(c, ArrayType(StringType())) for c in ("_left", "_right")] if with_proof else []
    final = StructType([*leaves.select(*out).schema.fields, *texts, *lists])
    if not rows:
        return df.sparkSession.createDataFrame([], final).select(*_final_columns(carry, names, with_proof))
    rounds = _grown(numbered(leaves, ["_order", "_digest"], rows), fanout, levels)
    subroots = rounds[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_order"), "_digest", F.lit(0).alias("_salt"))
    tops = _grown(numbered(subroots, ["_order"], rounds[-1].count()), fanout, levels)
    root = tops[-1].first()["_digest"]
    # Down again: first the tree of subroots, then the groups' own.
    nothing = F.array().cast("array<string>")
    paths = tops[-1].select("_g", "_pos", nothing.alias("_left"), nothing.alias("_right"), F.lit(None).cast("string").alias("_subroot"))
    for nodes in reversed(tops[1:-1]):
        paths = stage_table(_lowered(nodes, paths, fanout, levels), "paths")
    named = tops[0].select("_pos", F.col("_order").alias("_group"), "_digest")
    paths = stage_table(_lowered(tops[0], paths, fanout, levels), "paths").drop("_subroot", "_g").join(named, "_pos")
    paths = paths.select(F.col("_group").alias("_g"), F.lit(0).cast("long").alias("_pos"), "_left", "_right", F.col("_digest").alias("_subroot"))
    for nodes in reversed(rounds[1:-1]):
        paths = stage_table(_lowered(nodes, paths, fanout, levels), "paths")

    def prove(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return pa.table({f.name: left.column(f.name) if f.name in left.column_names and f.name[0] != "_" else pa.array([], pa.list_(pa.string()) if f.name in ("_left", "_right") else pa.string()) for f in final.fields})
        table, leaves, own, above, subroot = _inside(left, right, fanout, levels)
        data, others = leaves.tobytes(), table.column("_other").to_pylist()
        proofs, folded, lefts, rights = [], [], [], []
        for i, other in enumerate(others):
            path = _path(own, above, i, fanout)
            proofs.append(hashlib.sha256(b"".join([a + b for a, b in path])).hexdigest())
            folded.append(fold(other.encode() if other else data[i * WIDTH : (i + 1) * WIDTH], path).decode())
            if with_proof:
                lefts.append([a.decode() for a, _ in path])
                rights.append([b.decode() for _, b in path])
        done = {c: table.column(c) for c in out} | {"_digest": table.column("_digest"), "_subroot": [subroot] * len(others), "_root": [root] * len(others), "_proof": proofs, "_folded": folded}
        return pa.table(done | ({"_left": pa.array(lefts, pa.list_(pa.string())), "_right": pa.array(rights, pa.list_(pa.string()))} if with_proof else {}))

    blocks = rounds[0].withColumn("_block", F.floor(F.col("_pos") / fanout**levels)).drop("_order")
    done = blocks.groupBy("_g", "_block").cogroup(paths.groupBy("_g", "_pos")).applyInArrow(prove, final)
    return done.select(*_final_columns(carry, names, with_proof))


def _final_columns(carry: list[str], names: list[str], with_proof: bool) -> list[Column]:
    made = [*[F.col(c) for c in ("_digest", "_subroot", "_root", "_proof", "_folded")], F.col("_folded") == F.col("_root")]
    if with_proof:
        made.append(F.zip_with("_left", "_right", lambda a, b: F.struct(a.alias("left"), b.alias("right"))))
    return [*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[c.alias(n) for c, n in zip(made, names, strict=True)]]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` proved against a manifest by language; in a third of them the text was put into small letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": text})


def _sql_tree(name: str, leaves: str, depth: int) -> str:
    """CTEs of all levels over ``leaves`` (g, pos, h): ``name``0 and up, their siblings, and the node left."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {leaves})"]
    for k in range(depth):
        out.append(f"{name}s{k} AS (SELECT a.g, a.pos, any_value(a.c) > 1 AS live, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 8 = b.pos // 8 GROUP BY a.g, a.pos)")
        out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (SELECT g, pos // 8 AS pos, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, pos // 8))")
    return ",\n".join(out)


def _sql_fold(source: str, tree: str, key: str, depth: int, prefix: str) -> str:
    out = []
    for k in range(depth):
        out.append(
            f"{prefix}{k} AS (SELECT f.* REPLACE (CASE WHEN live THEN sha256(l || v || r) ELSE v END AS v, proof || l || r AS proof) FROM {source if k == 0 else f'{prefix}{k - 1}'} f JOIN {tree}s{k} s ON s.g = f.{key}g AND s.pos = f.{key}pos // {8**k})"
        )
    return ",\n".join(out)


def manifest_sql(depth: int = 8, groups_depth: int = 3) -> str:
    """DuckDB SQL for up to 8 ** ``depth`` rows a language and 8 ** ``groups_depth`` languages."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
    fields = [field.format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hit AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256(concat({", ".join(fields)}, {field.format("text")})) AS leaf, sha256(concat({", ".join(fields)}, {field.format("other")})) AS v FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
own AS (SELECT g, pos, leaf AS h FROM placed),
{_sql_tree("n", "own", depth)},
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS lang FROM n{depth}),
up AS (SELECT g, pos, h FROM tops),
{_sql_tree("m", "up", groups_depth)},
start AS (SELECT doc_id, leaf, p.g, p.pos, t.h AS subroot, t.g AS ug, t.pos AS upos, (SELECT h FROM m{groups_depth}) AS root, v, '' AS proof FROM placed p JOIN tops t ON t.lang = p.g),
{_sql_fold("start", "n", "", depth, "f")},
{_sql_fold(f"f{depth - 1}", "m", "u", groups_depth, "u")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, v AS folded_root, v = root AS verified FROM u{groups_depth - 1}
"""


OP11_SQL = manifest_sql()
