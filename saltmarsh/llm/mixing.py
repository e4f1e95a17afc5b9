"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by membership pattern (the set of sources a document belongs to), so the flow network has a
node for each pattern and source, never one for a document. A unit of pattern capacity costs 0 the first time, and
more each further time (convex), so a source whose target is above its size repeats evenly, and a document shared by
several sources goes where it spares repetition. The flow of a pattern to a source is then turned into documents: all
of them as often as the flow covers the whole pattern, and for the rest a seeded order (hash of doc_id and seed).
The seeded order is cut by histograms of hash ranges: the range of 12 bits in which a pattern's quota ends, then 12 bits
more within it, until no range has more than EDGE documents. Only those of the last range are ever ordered, and the last
document is taken in part, which makes a source's words equal its quota.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, the last; a null doc_id
is ordered by the hash of its text; ties in the seeded order go to the smaller doc_id, then to the smaller size. Repeated
rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents of a pattern that are put in order, at most (beyond equal hashes); the hash has LEVELS * BITS bits.
EDGE = 50_000
BITS, LEVELS = 12, 5
SEED = 20240229
#: Patterns and sources come to the driver as totals; more than this is an error. The solve takes seconds for as many.
MAX_NODES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, each stopped at most times its size, the excess shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / whole
            break
        for k in sorted(over):
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in sorted(over))
        free -= set(over)
    return out


def flow(patterns: Sequence[tuple[frozenset, int]], quotas: dict, most: int = MAX_REPEATS) -> dict[tuple[int, object], int]:
    """Words of pattern p for source s, of least cost: repetition r of a pattern's words costs r each.

    Primal-dual on source -> pattern -> sink. As all costs are at the sink and repetition r costs r in every pattern, the
    shortest paths of a phase are those to patterns that still have room at r repetitions, so a phase adds each pattern's
    size to its room and completes a maximum flow by blocking flows (levels by breadth, then depth-first along them);
    what the phases before have sent may be rerouted, never lost. Arcs are tried in the order of names, so reruns agree.
    """
    src, names = 0, sorted(quotas, key=lambda x: (x is None, x or ""))
    node = {x: 1 + k for k, x in enumerate(names)}
    first = 1 + len(names)
    sink = first + len(patterns)
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(u: int, v: int, c: int) -> int:
        for a, b, x in ((u, v, c), (v, u, 0)):
            out[a].append(len(to))
            to.append(b)
            cap.append(x)
        return len(to) - 2

    for x in names:
        arc(src, node[x], quotas[x])
    via, last = {}, []
    for k, (members, _) in enumerate(patterns):
        for x in sorted(members, key=lambda x: (x is None, x or "")):
            if x in node:
                via[arc(node[x], first + k, quotas[x])] = (k, x)
        last.append(arc(first + k, sink, 0))
    for _ in range(most):
        for a, (_, size) in zip(last, patterns, strict=True):
            cap[a] += size
        while (level := _levels(out, to, cap, src, sink)) is not None:
            _block(out, to, cap, level, src, sink)
    return {via[a]: cap[a ^ 1] for a in via if cap[a ^ 1]}


def _levels(out: list[list[int]], to: list[int], cap: list[int], src: int, sink: int) -> list[int] | None:
    """Arcs from src to each node along arcs with room; None where the sink can't be reached."""
    level = [-1] * len(out)
    level[src], now = 0, [src]
    while now and level[sink] < 0:
        after = []
        for u in now:
            for a in out[u]:
                if cap[a] and level[to[a]] < 0:
                    level[to[a]] = level[u] + 1
                    after.append(to[a])
        now = after
    return level if level[sink] >= 0 else None


def _block(out: list[list[int]], to: list[int], cap: list[int], level: list[int], src: int, sink: int) -> None:
    """Sends along paths that go down the levels until each has a full arc; an arc that leads nowhere is tried once."""
    tried, path, u = [0] * len(out), [], src
    while True:
        if u == sink:
            amount = min(cap[a] for a in path)
            for a in path:
                cap[a] -= amount
                cap[a ^ 1] += amount
            k = next(k for k, a in enumerate(path) if not cap[a])  # back to where the first full arc leaves
            u = to[path[k] ^ 1]
            del path[k:]
        arcs = out[u]
        while tried[u] < len(arcs) and not (cap[arcs[tried[u]]] and level[to[arcs[tried[u]]]] == level[u] + 1):
            tried[u] += 1
        if tried[u] < len(arcs):
            path.append(arcs[tried[u]])
            u = to[path[-1]]
        elif u == src:
            return
        else:
            a = path.pop()
            u = to[a ^ 1]
            tried[u] += 1


def seeded(doc_id: str, text: str, seed: int) -> Column:
    """The place in the seeded order: 60 bits of a digest of seed and doc_id; a null doc_id's are of its text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _cuts(base: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (members, whole, rest) with shift, cut, below: a pattern's rest ends among the documents whose h >> shift is cut.

    below is the size of those before. Each level has a row for each pattern and range; one row for each pattern stays.
    """
    spark, fields = base.sparkSession, "members array<string>, whole long, rest long, shift int, cut long, below long"
    plan = spark.createDataFrame([(*r, BITS * LEVELS, 0, 0) for r in plan.collect()], fields)
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = base.select("members", "size", "h").join(F.broadcast(plan), "members").where("rest > 0 AND shiftright(h, shift) = cut")
        bins = rows.groupBy("members", "rest", "below", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        below = F.col("below") + F.coalesce(F.sum("n").over(Window.partitionBy("members").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = bins.withColumn("below", below).where("below < rest AND below + n >= rest").select("members", "bin", "below", "rows").collect()
        found = {tuple(r["members"] or ()): r for r in ends}
        plan = [(r["members"], r["whole"], r["rest"], shift, f["bin"] if (f := found.get(tuple(r["members"] or ()))) else None, f["below"] if f else 0) for r in plan.collect()]
        plan = spark.createDataFrame(plan, fields)
        if max((r["rows"] for r in ends), default=0) <= EDGE:
            break
    return plan


def mix(docs: DataFrame, members: Column, weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, columns: Sequence[str] = ()) -> tuple[DataFrame, list[dict]]:
    """(doc_id, size, members, *columns, taken) of every row of docs, and a report: name, size, target, quota of each source.

    members: an array of the names of the sources a document belongs to (nulls allowed). taken counts repeats.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), seeded("doc_id", "text", seed).alias("h"), *columns)
    base = materialize(base, "mix")
    totals = base.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_NODES + 1).collect()
    if len(totals) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns")
    order = lambda x: (x is None, (x or "").encode())  # noqa: E731  code point order is UTF-8's byte order
    totals = sorted(((tuple(r["members"] or ()), int(r["size"])) for r in totals), key=lambda t: [order(x) for x in t[0]])
    names = sorted({x for t, _ in totals for x in t}, key=order)
    of: dict = {}
    for t, n in totals:
        for x in t:
            of[x] = of.get(x, 0) + n
    sizes = [of[x] for x in names]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    quotas = {x: round(t) for x, t in zip(names, wanted, strict=True)}
    routed = flow([(frozenset(t), n) for t, n in totals], quotas, most)
    spark = docs.sparkSession
    sent = [0] * len(totals)
    for (p, _), v in routed.items():
        sent[p] += v
    plan = [(list(t), sent[k], n) for k, (t, n) in enumerate(totals)]
    # a row per pattern: bounded by MAX_NODES
    plan_df = spark.createDataFrame([(t, v // n if n else 0, v % n if n else 0) for t, v, n in plan], "members array<string>, whole long, rest long")
    plan_df = _cuts(base, plan_df)
    rows = base.join(F.broadcast(plan_df), "members", "left").withColumn("bin", F.expr("shiftright(h, shift)"))
    # only the documents of one hash range per pattern are put in order
    before = F.coalesce(F.sum("size").over(Window.partitionBy("members").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where("bin = cut").withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("below") - before)))
    sure = rows.where("cut IS NULL OR bin <> cut").withColumn("part", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(0))
    out = edge.unionByName(sure).select("doc_id", "size", "members", *columns, (F.coalesce("whole", F.lit(0)) * F.col("size") + F.coalesce("part", F.lit(0))).cast("long").alias("taken"))
    return out, [{"source": x, "size": n, "target": t, "quota": quotas[x]} for x, n, t in zip(names, sizes, wanted, strict=True)]


def mix_by_source(docs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, *columns, taken): each document belongs to its source, null being one of its own."""
    out, report = mix(docs, F.array(F.col("source").cast("string")), columns=columns)
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["source"], r["size"], r["target"]) for r in report], "source string, source_size long, target double")
    out = out.withColumn("source", F.col("members")[0])
    return out.join(F.broadcast(known), out["source"].eqNullSafe(known["source"])).select("doc_id", "size", "source_size", "target", *columns, "taken")


#: Each document has one source, so the flow is forced: quotas by repeated sharing, documents in the seeded order.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5('20240229:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
r AS (SELECT 0 AS step, list({'source': source, 'n': n, 'w': w, 'stop': false}) AS x, CAST(sum(n) AS DOUBLE) AS left_over, CAST(sum(w) AS DOUBLE) AS whole, true AS more FROM src
    UNION ALL
    SELECT step + 1, y, list_sum([CAST(e.n AS DOUBLE) FOR e IN y]) - coalesce(list_sum([3.0::DOUBLE * e.n FOR e IN y IF e.stop]), 0), coalesce(list_sum([CAST(e.w AS DOUBLE) FOR e IN y IF NOT e.stop]), 0), len([1 FOR e IN y IF e.stop]) > len([1 FOR e IN x IF e.stop])
    FROM (SELECT *, [{'source': e.source, 'n': e.n, 'w': e.w, 'stop': e.stop OR left_over * e.w / whole > 3 * e.n} FOR e IN x] AS y FROM r WHERE more)),
t AS (SELECT e.source AS source, e.n AS n, CASE WHEN e.stop THEN CAST(3 * e.n AS DOUBLE) ELSE left_over * e.w / whole END AS target FROM (SELECT unnest(x) AS e, left_over, whole FROM r ORDER BY step DESC LIMIT (SELECT count(*) FROM src))),
q AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
o AS (SELECT d.doc_id, size, q.n AS source_size, target, CASE WHEN q.n = 0 THEN 0 ELSE quota // q.n END AS whole, CASE WHEN q.n = 0 THEN 0 ELSE quota % q.n END AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM o
"""
