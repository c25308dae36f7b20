"""Merkle manifest of a dataset: block trees in DuckDB inside the executors, outer trees and proofs as Spark joins.

A row is a leaf; per source the leaves ascend by doc_id and every FAN consecutive nodes
become their hash until one remains, the subroot; the subroots, by source, become the root alike.

1. Leaves.  Built-in functions digest each row where its text is read; texts are not shuffled.
2. Positions.  Leaves are dealt by ranges of (source, doc_id, leaf), sorted and written; a row's
   place in its file plus the counts of its source in earlier files is its position.  A source
   of any size is spread over the files.
3. Blocks.  FAN ** LEVELS consecutive leaves of one source, aligned, come as Arrow batches to a
   task, and DuckDB queries with an ordered ``string_agg`` and ``sha256`` give each level.
4. Outer trees.  Block roots (one per 4,096 leaves) and then subroots go up by one Spark
   aggregation a level, of FAN rows a group; each block gets its siblings left and right on
   each outer level.
5. Proofs.  The blocks come to DuckDB once more, each with its outer siblings as one row, so a
   document's proof (about a kilobyte a level) is made, digested and folded within one
   vector of a query and never leaves the task.

The manifest's tables are in the shared folder, so lost executors cost single tasks.

Edge cases: every column may be null (``-`` in the leaf); null sources form a tree of their own,
first in order; rows without doc_id come first in their source and are never tampered with; rows with equal
source and doc_id are ordered by their leaf, and rows equal in all columns are leaves each;
long texts are digested whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Children of a node, and levels that a block spans.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Rows that one DuckDB query takes at least, if there are so many; a block is never cut.
ROWS = 8192
#: Keys that may be broadcast; beyond, the join is a shuffle.
BROADCAST_KEYS = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIBLINGS = "array<struct<l:string,r:string>>"


@dataclass
class Manifest:
    """leaves(grp, doc_id, leaf, other, block, i, levels); above(grp, block, above, subroot, root): a block's siblings from its root up."""

    leaves: DataFrame
    above: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def counted(c: Column) -> Column:
    """The value behind its UTF-8 length and a colon; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*[counted(text if c == "text" else F.col(c)) for c in COLUMNS])


def tampered() -> Column:
    """Rows whose text is tampered with: 5 divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, other): ``grp`` orders sources bytewise, null first; ``other`` is the leaf after tampering."""
    grp = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    other = F.when(tampered(), leaf(F.translate("text", UPPER, LOWER))).otherwise(F.col("leaf"))
    return docs.select(*COLUMNS).withColumn("leaf", leaf(F.col("text"))).select(grp.alias("grp"), "doc_id", "leaf", other.alias("other"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(grp, ...)`` with ``pos``, the place in the group by ``order``, and ``size``, the group's rows."""
    dealt = materialize(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()))
    # The upper bits of ``at`` number the file, the lower ones the row in it.
    parts = dealt.groupBy("grp", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(parts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("size")))
    some = F.broadcast(offsets) if offsets.count() <= BROADCAST_KEYS else offsets
    placed = dealt.withColumn("part", F.shiftright("at", 33)).join(some, ["grp", "part"])
    return placed.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "size")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole blocks, of ROWS rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        differ = pc.or_(*[pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)) for c in ("grp", "block")])
        last = pc.max(pc.if_else(differ, pa.array(range(1, table.num_rows)), None)).as_py()  # where the last block begins
        if last:
            yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


#: The runs of each level of the blocks in ``rows``, bottom up, and the block's root.
_TREES = "WITH n0 AS (SELECT grp, block, levels, i AS p, leaf AS h FROM rows WHERE i >= 0)" + "".join(
    f""",
r{k} AS MATERIALIZED (SELECT grp, block, levels, p // {FAN} AS up, string_agg(h, '' ORDER BY p) AS run FROM n{k} GROUP BY ALL),
n{k + 1} AS (SELECT grp, block, levels, up AS p, CASE WHEN levels > {k} THEN sha256(run) ELSE run END AS h FROM r{k})"""
    for k in range(LEVELS)
)
ROOTS = f"{_TREES} SELECT grp, block, h FROM n{LEVELS}"


def _proofs(depth: int) -> str:
    """Each leaf's proof and fold through the block's levels and ``depth`` outer ones."""
    joins, proof, folds = [], [], []
    for k in range(LEVELS):
        place = f"(n.i // {FAN**k} % {FAN})"
        left, right = f"substr(r{k}.run, 1, 64 * {place})", f"substr(r{k}.run, 64 * {place} + 65)"
        joins.append(f"JOIN r{k} ON r{k}.grp = n.grp AND r{k}.block = n.block AND r{k}.up = n.i // {FAN ** (k + 1)}")
        proof.append(f"{left} || {right}")
        below = f"f{k - 1}" if k else "n.other"
        folds.append(f"CASE WHEN n.levels > {k} THEN sha256({left} || {below} || {right}) ELSE {below} END AS f{k}")
    folds += [f"CASE WHEN len(t.above) > {k} THEN sha256(t.above[{k + 1}].l || f{LEVELS + k - 1} || t.above[{k + 1}].r) ELSE f{LEVELS + k - 1} END AS f{LEVELS + k}" for k in range(depth)]
    whole = " || ".join(proof) + " || array_to_string(list_transform(t.above, lambda x: x.l || x.r), '')"
    inner = f"SELECT n.doc_id, n.leaf, t.subroot, t.root, {whole} AS proof, {', '.join(folds)} FROM rows n {' '.join(joins)} JOIN rows t ON t.grp = n.grp AND t.block = n.block AND t.i < 0 WHERE n.i >= 0"
    return f"{_TREES} SELECT doc_id, leaf, subroot, root, proof, sha256(proof) AS proof_sha256, f{LEVELS + depth - 1} AS folded_root FROM ({inner})"


def _ask(con, table: pa.Table, sql: str) -> pa.Table:
    con.register("rows", table)
    try:
        return con.execute(sql).to_arrow_table()
    finally:
        con.unregister("rows")


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def block_roots(rows: DataFrame) -> DataFrame:
    """(grp, block, h) of ``rows(grp, block, i, levels, leaf)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for table in _whole(batches):
            yield from _ask(con, table, ROOTS).select(["grp", "block", "h"]).to_batches()

    dealt = rows.select("grp", "block", "i", "levels", "leaf").repartition("grp", "block").sortWithinPartitions("grp", "block", "i")
    return dealt.mapInArrow(run, "grp string, block long, h string")


def outer(nodes: DataFrame) -> DataFrame:
    """(grp, block, above, top): siblings of each of ``nodes(grp, block, n, h)`` up to its group's root.

    n is the number of nodes in the group.  One aggregation a level, of FAN rows a group; rows shrink
    FAN times a level, and the levels follow from the largest group.
    """
    level = nodes.select("grp", F.col("block").alias("at"), "n", "h")
    path = nodes.select("grp", "block", F.col("block").alias("at"), "h", "n", F.array().cast(SIBLINGS).alias("above"))
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        runs = materialize(level.filter("n > 1").groupBy("grp", F.expr(f"at div {FAN}").alias("up")).agg(run.alias("run"), F.ceil(F.max("n") / FAN).alias("up_n")))
        level = runs.select("grp", F.col("up").alias("at"), F.col("up_n").alias("n"), F.sha2("run", 256).alias("h"))
        place = F.col("at") % FAN * 64
        beside = F.struct(F.substr("run", F.lit(1), place.cast("int")).alias("l"), F.substr("run", (place + 65).cast("int")).alias("r"))
        up = path.withColumn("up", F.when(F.col("n") > 1, F.expr(f"at div {FAN}"))).join(runs, ["grp", "up"], "left")
        went = F.col("run").isNotNull()
        path = materialize(up.select("grp", "block", F.when(went, F.col("up")).otherwise(F.col("at")).alias("at"), F.when(went, F.sha2("run", 256)).otherwise(F.col("h")).alias("h"), F.when(went, F.col("up_n")).otherwise(F.col("n")).alias("n"), F.when(went, F.array_append("above", beside)).otherwise(F.col("above")).alias("above")))
        most = -(-most // FAN)
    return path.select("grp", "block", "above", F.col("h").alias("top"))


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``."""
    placed = positions(materialize(leaves(docs)), ["doc_id", "leaf"])
    steps = sum((F.when(F.col("size") > FAN**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    rows = placed.select("grp", "doc_id", "leaf", "other", F.expr(f"pos div {BLOCK}").alias("block"), (F.col("pos") % BLOCK).cast("int").alias("i"), steps.cast("int").alias("levels"), "size")
    roots = materialize(block_roots(rows))
    sizes = roots.groupBy("grp").agg(F.count("*").alias("n"))
    inner = materialize(outer(roots.join(sizes, "grp").select("grp", "block", "n", "h")))
    # The subroots are one group, in the order of the sources.
    tops = inner.filter("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("src"), F.col("top").alias("h"))
    ranked = materialize(positions(tops, ["src"]))
    top = outer(ranked.select("grp", F.col("pos").alias("block"), F.col("size").alias("n"), "h"))
    named = ranked.join(top, ranked.pos == top.block).select(F.col("src").alias("grp"), F.col("above").alias("over"), F.col("top").alias("root"))
    above = inner.join(named, "grp").select("grp", "block", F.concat("above", "over").alias("above"), F.col("top").alias("subroot"), "root")
    return Manifest(rows.drop("size"), materialize(above))


def prove(m: Manifest, proof: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) per leaf; ``proof``: also its siblings' digests as one text."""
    names = ["doc_id", "leaf", "subroot", "root", *(["proof"] if proof else []), "proof_sha256", "folded_root"]
    kind = m.leaves.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for table in _whole(batches):
            depth = pc.max(pc.list_value_length(table.column("above"))).as_py() or 0
            yield from _ask(con, table, _proofs(depth)).select(names).to_batches()

    none = lambda t, n: F.lit(None).cast(t).alias(n)
    rows = m.leaves.select("grp", "block", "i", "levels", "doc_id", "leaf", "other", none(SIBLINGS, "above"), none("string", "subroot"), none("string", "root"))
    tops = m.above.select("grp", "block", F.lit(-1).alias("i"), F.lit(0).alias("levels"), none(kind, "doc_id"), none("string", "leaf"), none("string", "other"), "above", "subroot", "root")
    dealt = rows.unionByName(tops).repartition("grp", "block").sortWithinPartitions("grp", "block", "i")
    return dealt.mapInArrow(run, ", ".join(f"{n} {kind if n == 'doc_id' else 'string'}" for n in names))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    found = prove(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(depth: int = 5) -> str:
    """The same in DuckDB, for trees of up to FAN ** depth leaves."""
    part = lambda c: f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::bigint)"
    out = [
        f"WITH leaves AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS g, {whole('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {whole(f'translate(text, {UPPER!r}, {LOWER!r})')} ELSE {whole('text')} END AS other FROM documents)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS p0, leaf AS h0, count(*) OVER (PARTITION BY g) AS c0, other AS f0, '' AS s0 FROM leaves)",
    ]

    def level(source: str, k: int, group: str) -> None:
        """One level up: runs, then each row's own, its siblings' and its fold's digest."""
        out.append(f"{source}r{k} AS MATERIALIZED (SELECT {group}, p{k} // {FAN} AS up, c{k} AS c, string_agg(h, '' ORDER BY p{k}) AS run FROM (SELECT DISTINCT {group}, p{k}, c{k}, h{k} AS h FROM {source}{k}) GROUP BY ALL)")
        left, right = f"substr(run, 1, 64 * (p{k} % {FAN}))", f"substr(run, 64 * (p{k} % {FAN}) + 65)"
        up = lambda yes, no: f"CASE WHEN c{k} > 1 THEN {yes} ELSE {no} END"
        out.append(
            f"{source}{k + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (p{k}, h{k}, c{k}, f{k}, s{k}), {up('r.up', f'p{k}')} AS p{k + 1}, {up('sha256(run)', f'h{k}')} AS h{k + 1}, (c{k} + {FAN - 1}) // {FAN} AS c{k + 1}, "
            f"{up(f'sha256({left} || f{k} || {right})', f'f{k}')} AS f{k + 1}, {up(f's{k} || {left} || {right}', f's{k}')} AS s{k + 1} FROM {source}{k} a JOIN {source}r{k} r ON a.{group} = r.{group} AND a.p{k} // {FAN} = r.up)"
        )

    for k in range(depth):
        level("a", k, "g")
    out.append(f"b0 AS MATERIALIZED (SELECT doc_id, leaf, h{depth} AS subroot, 0 AS one, dense_rank() OVER (ORDER BY encode(g)) - 1 AS p0, h{depth} AS h0, (SELECT count(DISTINCT g) FROM leaves) AS c0, f{depth} AS f0, s{depth} AS s0 FROM a{depth})")
    for k in range(depth):
        level("b", k, "one")
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, h{depth} AS root, sha256(s{depth}) AS proof_sha256, f{depth} AS folded_root, f{depth} = h{depth} AS verified FROM b{depth}"


ORACLE_SQL = _oracle()
