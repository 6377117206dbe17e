"""Merkle manifest of a dataset: each row's proof up to one root, gathered by a butterfly exchange of subtree roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import ordered
from .common import let, materialize, release

#: Children of a node, and levels of the tree that a partition builds by itself: it holds FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 16, 3
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over the values: ``-`` for a null, else the count of UTF-8 bytes, a colon and the value, integers in decimal."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in columns]), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _parents(nodes: Column, fanout: int) -> Column:
    """The digests over each run of ``fanout`` nodes; the last run may be shorter."""
    last = lambda x: F.floor((F.size(x) - 1) / fanout).cast("int")
    return let(nodes, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda i: F.sha2(_joined(F.slice(x, i * fanout + 1, F.lit(fanout))), 256)))


def _around(nodes: Column, at: Column, fanout: int) -> Column:
    """The siblings to the left and to the right of node ``at`` in its run."""
    run = (F.floor(at / fanout) * fanout).cast("int")
    return F.struct(_joined(F.slice(nodes, run + 1, at - run)).alias("left"), _joined(F.slice(nodes, at + 2, run + fanout - 1 - at)).alias("right"))


def _swap(rows: DataFrame, active: Column, group: list[Column], digit: Column, span: Column) -> DataFrame:
    """One round: the members at the same place ``low`` of up to ``fanout`` sibling subtrees hand each other their subtrees' roots, and each hashes the
    parent. A subtree of ``width`` members that is smaller than its largest sibling stands in at the places it doesn't have, up to ``span``, so every member finds
    one partner in each sibling. No group has more rows than a node has children."""
    places = F.sequence(F.col("low"), F.when(active, span).otherwise(F.col("low") + 1) - 1, F.col("width"))
    sent = rows.withColumn("__at", F.explode(places)).withColumn("__digit", digit)
    met = F.sort_array(F.collect_list(F.struct("__digit", "node", "width")).over(Window.partitionBy(*group, "__at")))
    met = sent.withColumn("__met", met).where(F.col("__at") == F.col("low"))
    side = lambda test: _joined(F.transform(F.filter("__met", test), lambda x: x["node"]))
    left, right = side(lambda x: x["__digit"] < F.col("__digit")), side(lambda x: x["__digit"] > F.col("__digit"))
    total = lambda nodes: F.aggregate(nodes, F.lit(0).cast("long"), lambda acc, x: acc + x["width"])
    ahead = total(F.filter("__met", lambda x: x["__digit"] < F.col("__digit")))
    new = {
        "path": F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))),
        "node": F.sha2(_joined(F.transform("__met", lambda x: x["node"])), 256),
        "low": F.col("low") + ahead,
        "width": total(F.col("__met")),
    }
    return met.select(*[F.when(active, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in rows.columns])


def _height(n: int, fanout: int) -> int:
    """How many rounds join ``n`` nodes into one."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def _butterfly(blocks: DataFrame, sources: DataFrame, fanout: int) -> DataFrame:
    """(source, block, subroot, root, path): what each partition knows after all rounds. ``blocks`` has source, block, node; ``sources`` has source and its number of ``blocks``.

    The rounds go up the trees of all sources at once, then up the tree of their subroots in order of source."""
    known = sources.agg(F.count("*"), F.max("blocks")).first()
    inner, outer = _height(known[1] or 0, fanout), _height(known[0], fanout)
    placed = listed = ordered(sources, [F.col("source").asc_nulls_first()], name="s")
    for r in range(outer):  # how far a round reaches among sources: its widest subtree
        widths = listed.groupBy(F.floor(F.col("s") / fanout**r).alias("__n")).agg(F.sum("blocks").alias("__w"))
        widths = widths.groupBy(F.floor(F.col("__n") / fanout).alias("__over")).agg(F.max("__w").alias(f"span{r}"))
        listed = listed.join(widths, F.floor(F.col("s") / fanout ** (r + 1)) == F.col("__over")).drop("__over")
    spans = [f"span{r}" for r in range(outer)]
    named = listed.select(F.col("source").alias("__source"), "s", F.col("blocks").alias("n"), *spans)
    rows = blocks.join(named, F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.select("source", "s", "block", "n", *spans, "node", F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("width"), F.array().cast(_PATH).alias("path"))
    rows = written = materialize(rows, "manifest-round")
    release(placed)

    def then(step: DataFrame) -> DataFrame:
        nonlocal written
        out = materialize(step, "manifest-round")
        release(written)
        written = out
        return out

    for r in range(inner):
        step, over = fanout**r, F.floor(F.col("block") / fanout ** (r + 1))
        whole = F.col("n") > over * fanout ** (r + 1) + step  # the first of the group has all its members, and isn't alone
        rows = then(_swap(rows, F.col("n") > step, [F.col("s"), over], F.floor(F.col("block") / step) % fanout, F.when(whole, F.lit(step).cast("long")).otherwise(F.col("width"))))
    rows = rows.withColumn("subroot", F.col("node"))
    for r in range(outer):
        rows = then(_swap(rows, F.lit(True), [F.floor(F.col("s") / fanout ** (r + 1))], F.floor(F.col("s") / fanout**r) % fanout, F.col(f"span{r}")))
    out = rows.select("source", "block", "subroot", F.col("node").alias("root"), "path")
    out._scratch_path = written._scratch_path
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", by: str = "source", tampered: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf is the digest of ``columns``. The leaves of one ``by`` value, in order of the key (null first, equal keys by leaf), are joined in runs of ``fanout`` until one node is left, the
    subroot; subroots in order of ``by`` (null first) are joined likewise to the root. The proof is the siblings' digests from the leaf up. ``tampered`` gives
    other values of columns; the root is folded again from the leaf of these with the original siblings.

    A partition holds ``fanout ** levels`` leaves of one ``by`` value and builds their subtree. Then partitions whose subtrees are siblings swap roots, round by
    round, and each hashes all its ancestors itself; at the end it has the upper part of its leaves' proofs, and nothing is passed down. Texts are hashed where they are read
    and not shuffled. Repeated rows are leaves of their own; nulls in any column and a null ``by`` are values like any other; other columns are ignored; an empty
    table gives no rows."""
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    forged = leaf_digest([(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]) if tampered else F.lit(None).cast("string")
    leaves = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{by}`").alias("source"), leaf.alias("leaf"), forged.alias("forged"))
    leaves = materialize(leaves.withColumn("forged", F.when(F.col("forged") != F.col("leaf"), F.col("forged"))), "manifest-leaves")
    size = fanout**levels
    placed = ordered(leaves, [F.col("key").asc_nulls_first(), F.col("leaf")], by=["source"], name="at", count="total")
    blocks = placed.groupBy("source", F.floor(F.col("at") / size).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", "key", "leaf", "forged"))).alias("rows"))
    tree = ["t0"]
    blocks = blocks.withColumn("t0", F.transform("rows", lambda x: x["leaf"]))
    for k in range(levels):  # a source that fits into one partition ends at its one node
        blocks = blocks.withColumn(f"t{k + 1}", F.when(F.col("total") > fanout**k, _parents(F.col(f"t{k}"), fanout)).otherwise(F.col(f"t{k}")))
        tree.append(f"t{k + 1}")
    blocks = materialize(blocks.drop("t0").withColumn("node", F.col(tree[-1])[0]).drop(tree[-1]), "manifest-blocks")
    release(leaves, placed)
    sources = materialize(blocks.groupBy("source").agg(F.count("*").alias("blocks")), "manifest-sources")
    upper = _butterfly(blocks.select("source", "block", "node"), sources, fanout)
    u = upper.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "subroot", "root", "path")
    whole = blocks.join(u, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).withColumn("t0", F.transform("rows", lambda x: x["leaf"]))

    def proven(x: Column, i: Column) -> Column:
        lower = [F.when(F.col("total") > fanout**k, F.array(_around(F.col(tree[k]), F.floor(i / fanout**k).cast("int"), fanout))).otherwise(F.array().cast(_PATH)) for k in range(levels)]
        path = F.concat(*lower, F.col("path"))
        fold = lambda p: F.aggregate(p, F.coalesce(x["forged"], x["leaf"]), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
        return let(path, lambda p: F.struct(x["key"].alias("key"), x["leaf"].alias("leaf"), F.sha2(_joined(F.transform(p, lambda s: F.concat(s["left"], s["right"]))), 256).alias("proof"), fold(p).alias("folded")))

    each = whole.select("subroot", "root", F.explode(F.transform("rows", proven)).alias("r"))
    return each.select(F.col("r.key").alias(key), F.col("r.leaf").alias("leaf"), "subroot", "root", F.col("r.proof").alias("proof_sha256"), F.col("r.folded").alias("folded_root"), (F.col("r.folded") == F.col("root")).alias("verified"))


def oracle_sql(fanout: int = FANOUT) -> str:
    """The manifest of ``op11_merkle_manifest`` for DuckDB: nodes level by level, and proofs as sums of texts of siblings."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([*[value(c) for c in ("doc_id", "source", "lang", "n_chars")], value(t)]) + ")"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(text)} ELSE {leaf('text')} END AS forged FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM d),
    inner_ AS (SELECT source, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p
        UNION ALL SELECT source, any_value(lv) + 1, pos // {fanout}, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + {fanout - 1}) // {fanout}) FROM inner_ WHERE n > 1 GROUP BY source, pos // {fanout}),
    subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, (SELECT max(x.lv) FROM inner_ x WHERE x.source IS NOT DISTINCT FROM inner_.source) AS top FROM inner_ WHERE n = 1),
    outer_ AS (SELECT 0 AS lv, s AS pos, subroot AS h, count(*) OVER () AS n FROM subs
        UNION ALL SELECT any_value(lv) + 1, pos // {fanout}, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + {fanout - 1}) // {fanout}) FROM outer_ WHERE n > 1 GROUP BY pos // {fanout}),
    mine AS (SELECT p.*, s.subroot, s.s, s.top FROM p JOIN subs s ON p.source IS NOT DISTINCT FROM s.source),
    sib AS (SELECT doc_id, leaf, m.pos AS place, i.lv, i.pos < m.pos // ({fanout} ** i.lv)::BIGINT AS before, i.pos, i.h FROM mine m JOIN inner_ i ON i.source IS NOT DISTINCT FROM m.source AND i.lv < m.top AND i.pos // {fanout} = m.pos // ({fanout} ** (i.lv + 1))::BIGINT AND i.pos <> m.pos // ({fanout} ** i.lv)::BIGINT
        UNION ALL SELECT doc_id, leaf, m.pos, m.top + o.lv, o.pos < m.s // ({fanout} ** o.lv)::BIGINT, o.pos, o.h FROM mine m JOIN outer_ o ON o.n > 1 AND o.pos // {fanout} = m.s // ({fanout} ** (o.lv + 1))::BIGINT AND o.pos <> m.s // ({fanout} ** o.lv)::BIGINT),
    steps AS (SELECT doc_id, leaf, place, lv, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS r FROM sib GROUP BY ALL),
    proofs AS (SELECT doc_id, leaf, place, sha256(string_agg(l || r, '' ORDER BY lv)) AS proof_sha256 FROM steps GROUP BY ALL),
    levels AS (SELECT doc_id, leaf, pos AS place, forged, m.subroot, top + (SELECT max(lv) FROM outer_) AS depth FROM mine m),
    fold AS (SELECT doc_id, leaf, place, subroot, 0 AS lv, depth, forged AS h FROM levels
        UNION ALL SELECT f.doc_id, f.leaf, f.place, f.subroot, f.lv + 1, depth, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) FROM fold f LEFT JOIN steps s ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.leaf = f.leaf AND s.place = f.place AND s.lv = f.lv WHERE f.lv < f.depth),
    root AS (SELECT h AS root FROM outer_ WHERE n = 1)
    SELECT f.doc_id, f.leaf, f.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
    FROM fold f LEFT JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM f.doc_id AND q.leaf = f.leaf AND q.place = f.place, root WHERE f.lv = f.depth"""
