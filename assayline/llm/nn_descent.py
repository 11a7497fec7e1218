"""Approximate nearest neighbours by inner product: an NN-descent graph, and greedy search in it.

Only distinct vectors are nodes; copies of a vector are found through it, so a vector
that a third of all rows share costs one node.  Nodes live in buckets of about
``BUCKET_NODES``, one row each, with their vectors and neighbour lists as arrays.

Start: nodes are dealt, ``ROUNDS`` times, into cells by random hyperplanes (a cell that
is too large is dealt on by hash) and compared within their cell.
Each round of NN-descent joins the graph with itself: reversed links meet their
bucket; a bucket asks for the vectors of its nodes' neighbours and reversed
neighbours; of those, all neighbours of one node, the ones whose link is new are compared
with all, and pairs better than a list's last entry are sent to the list's bucket and
merged.  So a round costs what the last one changed.  Rounds end when few entries
change, ``MAX_ROUNDS`` at the latest.
Search: a query starts from its own node's list and keeps a beam; each step its best
nodes not yet expanded name their neighbours, whose buckets answer with similarity
and neighbour list.

Work and messages per node are bounded by the list length, whatever the number of
nodes.  What bounds a list (neighbours, sampled reversed neighbours, beam) makes the
search approximate; recall is measured in the tests and the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import mixed, pin, runs, split_by, unpin
from assayline.operators.spread import top_n

#: List length, nodes per bucket, cells of the start, rounds.
K, BUCKET_NODES, CELL_NODES, ROUNDS, MAX_ROUNDS = 40, 2048, 2048, 3, 8
#: Rounds end when less than this part of all list entries is new.
SETTLED = 0.02
#: Beam of the search, nodes expanded per step, steps.
BEAM, EXPAND, STEPS = 120, 40, 5

GRAPH = "bucket int, nodes binary, vecs binary, nbrs binary, sims binary, fresh binary"
LINKS = "bucket int, a binary, b binary, s binary"


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def link_rows(bucket: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    """Links as arrays, one row per bucket that gets any."""
    order, bounds = split_by(bucket, n)
    got = np.flatnonzero(np.diff(bounds))
    blob = lambda x: pa.array([x[order[bounds[k] : bounds[k + 1]]].tobytes() for k in got], pa.binary())
    return pa.table({"bucket": pa.array(got.astype(np.int32)), "a": blob(a.astype(np.int64)), "b": blob(b.astype(np.int64)), "s": blob(s.astype(np.float32))})


def links_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda c, t: np.concatenate([np.empty(0, t), *(np.frombuffer(x, t) for x in rows[c].to_pylist())])
    return join("a", np.int64), join("b", np.int64), join("s", np.float32)


class Bucket:
    """The nodes of a bucket; lists are padded with -1 and minus infinity."""

    def __init__(self, rows: pa.Table):
        one = {c: rows[c][0].as_py() for c in ("nodes", "vecs", "nbrs", "sims", "fresh")}
        self.number = rows["bucket"][0].as_py()
        self.nodes = np.frombuffer(one["nodes"], np.int64)
        self.vecs = np.frombuffer(one["vecs"], np.float32).reshape(len(self.nodes), -1)
        self.nbrs = np.frombuffer(one["nbrs"], np.int64).reshape(len(self.nodes), -1)
        self.sims = np.frombuffer(one["sims"], np.float32).reshape(len(self.nodes), -1)
        self.fresh = np.frombuffer(one["fresh"], bool).reshape(self.nbrs.shape)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Nodes are kept in ascending order."""
        return np.searchsorted(self.nodes, ids)


def graph_row(number: int, nodes: np.ndarray, vecs: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.Table:
    arrays = {"nodes": nodes, "vecs": vecs.astype(np.float32), "nbrs": nbrs.astype(np.int64), "sims": sims.astype(np.float32), "fresh": fresh}
    return pa.table({"bucket": pa.array([number], pa.int32())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in arrays.items()})


def best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists (n, k) of each owner's most similar others, each once, ties to the smaller id."""
    order = np.lexsort((other, owner))
    owner, other, sim = owner[order], other[order], sim[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim = owner[new], other[new], sim[new]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim = owner[order], other[order], sim[order]
    start = runs(owner)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < k
    nbrs, sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    nbrs[owner[keep], rank[keep]], sims[owner[keep], rank[keep]] = other[keep], sim[keep]
    return nbrs, sims


def start_graph(nodes: DataFrame, n: int, n_buckets: int, k: int) -> DataFrame:
    """The first graph over ``nodes`` (node, vec): neighbours within random cells."""
    size = len(nodes.first()["vec"])
    bits = max(0, round(math.log2(max(n / CELL_NODES, 1))))
    planes = np.random.default_rng(11).standard_normal((ROUNDS, size, bits)).astype(np.float32)

    def deal(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            if not batch.num_rows:
                continue
            ids = batch.column("node").to_numpy()
            vecs = np.array(batch.column("vec").to_pylist(), np.float32)
            for r in range(ROUNDS):
                cell = ((vecs @ planes[r] > 0) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), r, np.int32)), pa.array(cell.astype(np.int64)), pa.array(ids), pa.array([v.tobytes() for v in vecs], pa.binary())],
                    ["r", "cell", "node", "vec"],
                )

    dealt = pin(nodes.mapInArrow(deal, "r int, cell long, node long, vec binary"))
    sizes = dealt.groupBy("r", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL_NODES)).alias("parts"))
    cells = dealt.join(sizes, ["r", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "r"), F.col("parts"))).drop("parts")

    def compare(rows: pa.Table) -> pa.Table:
        ids = rows["node"].to_numpy()
        vecs = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.float32).reshape(len(ids), -1)
        a, b, s = [], [], []
        few = min(k, len(ids) - 1)
        for i in range(0, len(ids) if few > 0 else 0, 512):
            sim = vecs[i : i + 512] @ vecs.T
            sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -np.inf
            top = np.argpartition(-sim, few - 1, axis=1)[:, :few]
            a.append(np.repeat(ids[i : i + 512], few))
            b.append(ids[top].ravel())
            s.append(np.take_along_axis(sim, top, 1).ravel())
        a, b, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, s))
        return link_rows(bucket_of(a, n_buckets), n_buckets, a, b, s)

    links = cells.groupBy("r", "cell", "part").applyInArrow(compare, LINKS)

    def fill(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(rows["node"].to_numpy())
        ids = rows["node"].to_numpy()[order]
        vecs = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.float32).reshape(len(ids), -1)[order]
        a, b, s = links_of(found)
        nbrs, sims = best(np.searchsorted(ids, a), b, s, len(ids), k)
        return graph_row(rows["bucket"][0].as_py(), ids, vecs, nbrs, sims, nbrs >= 0)

    def placed(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            where = bucket_of(batch.column("node").to_numpy(), n_buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("node"), batch.column("vec")], ["bucket", "node", "vec"])

    homes = dealt.where("r = 0").select("node", "vec").mapInArrow(placed, "bucket int, node long, vec binary")
    return pin(homes.groupBy("bucket").cogroup(links.groupBy("bucket")).applyInArrow(fill, GRAPH))


def sampled(owner: np.ndarray, other: np.ndarray, fresh: np.ndarray, n: int, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) of each owner's others, at most k, new ones first and then by hash, padded with -1; and which are new."""
    luck = (mixed(other.view(np.uint64) * np.uint64(31) + owner.astype(np.uint64) + np.uint64(salt)) >> np.uint64(41)).astype(np.float32) / (1 << 23)
    others, rank = best(owner, other, luck + (fresh > 0), n, k)
    return others, rank >= 1


def descend(graph: DataFrame, n_buckets: int, k: int, turn: int) -> DataFrame:
    """One round of NN-descent.  Adds ``n_fresh``, the number of new list entries, to each bucket."""

    def reverse(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            for i in range(batch.num_rows):
                g = Bucket(pa.Table.from_batches([batch.slice(i, 1)]))
                have = g.nbrs >= 0
                b = g.nbrs[have]
                yield from link_rows(bucket_of(b, n_buckets), n_buckets, b, np.repeat(g.nodes, have.sum(axis=1)), g.fresh[have]).to_batches()

    reversed_links = graph.mapInArrow(reverse, LINKS)

    def members(g: Bucket, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(n, 2k + 1): the node, its neighbours, and a sample of those that it is a neighbour of, new ones first; and which are new."""
        a, b, new = links_of(found)
        back, back_new = sampled(g.place(a), b, new, len(g.nodes), k, turn)
        lists = np.concatenate([g.nodes[:, None], g.nbrs, back], axis=1)
        fresh = np.concatenate([np.zeros((len(lists), 1), bool), g.fresh, back_new], axis=1)
        order = np.argsort(~fresh, axis=1, kind="stable")
        return np.take_along_axis(lists, order, 1), np.take_along_axis(fresh, order, 1)

    def ask(rows: pa.Table, found: pa.Table) -> pa.Table:
        g = Bucket(rows)
        lists, fresh = members(g, found)
        wanted = np.unique(lists[fresh.any(axis=1)])
        wanted = wanted[wanted >= 0]
        return link_rows(bucket_of(wanted, n_buckets), n_buckets, wanted, np.full(len(wanted), g.number), np.zeros(len(wanted)))

    asked = graph.groupBy("bucket").cogroup(reversed_links.groupBy("bucket")).applyInArrow(ask, LINKS)

    def give(rows: pa.Table, found: pa.Table) -> pa.Table:
        g = Bucket(rows)
        out: dict[str, list] = {"bucket": [], "a": [], "b": [], "s": []}
        for ids, to in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            at = g.place(ids)
            out["bucket"].append(int(np.frombuffer(to, np.int64)[0]))
            out["a"].append(ids.tobytes())
            out["b"].append(g.vecs[at].tobytes())
            out["s"].append(g.sims[at, -1].tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32())} | {c: pa.array(out[c], pa.binary()) for c in ("a", "b", "s")})

    given = graph.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(give, LINKS)
    sent = reversed_links.withColumn("kind", F.lit(0)).union(given.withColumn("kind", F.lit(1)))

    def compare(rows: pa.Table, found: pa.Table) -> pa.Table:
        g = Bucket(rows)
        kind = np.array(found["kind"].to_pylist())
        lists, fresh = members(g, found.filter(pa.array(kind == 0)))
        got = found.filter(pa.array(kind == 1))
        if not got.num_rows:
            return link_rows(*[np.empty(0, np.int64), n_buckets, *[np.empty(0, np.int64)] * 3])
        some = np.flatnonzero(fresh.any(axis=1))
        some = some[np.argsort(fresh[some].sum(axis=1), kind="stable")]  # lists with as many new members together
        lists, fresh = lists[some], fresh[some]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in got["a"].to_pylist()])
        vecs = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, g.vecs.shape[1]) for x in got["b"].to_pylist()])
        least = np.concatenate([np.frombuffer(x, np.float32) for x in got["s"].to_pylist()])
        order = np.argsort(ids)
        ids, vecs, least = ids[order], vecs[order], least[order]
        vecs, least = np.concatenate([vecs, np.zeros_like(vecs[:1])]), np.append(least, np.float32(np.inf))  # the last stands for -1
        at = np.where(lists >= 0, np.searchsorted(ids, lists), len(ids))
        a, b, s = [], [], []
        for i in range(0, len(at), 64):
            p, new = at[i : i + 64], int(fresh[i : i + 64].sum(axis=1).max())
            q = p[:, :new]
            sim = vecs[q] @ vecs[p].transpose(0, 2, 1)
            pair = (p < len(ids))[:, None, :] & (q < len(ids))[:, :, None] & (q[:, :, None] != p[:, None, :])
            for c, x, y in (np.nonzero(pair & (sim > least[q][:, :, None])), np.nonzero(pair & (sim > least[p][:, None, :]))):
                a.append((q[c, x], p[c, y])[len(a) % 2])
                b.append((p[c, y], q[c, x])[len(b) % 2])
                s.append(sim[c, x, y])
        a, b, s = (np.concatenate(x) for x in (a, b, s))
        nbrs, sims = best(a, b, s, len(ids), k)
        who, where = np.nonzero(nbrs >= 0)
        a, b, s = ids[who], ids[nbrs[who, where]], sims[who, where]
        return link_rows(bucket_of(a, n_buckets), n_buckets, a, b, s)

    better = graph.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(compare, LINKS)

    def merge(rows: pa.Table, found: pa.Table) -> pa.Table:
        g = Bucket(rows)
        a, b, s = links_of(found)
        have = g.nbrs >= 0
        own = np.repeat(np.arange(len(g.nodes)), have.sum(axis=1))
        # An entry that is there already comes first, so that it keeps its similarity.
        nbrs, sims = best(np.concatenate([own, g.place(a)]), np.concatenate([g.nbrs[have], b]), np.concatenate([g.sims[have], s]), len(g.nodes), k)
        pair = lambda x: x + np.arange(len(g.nodes))[:, None] * np.int64(-7046029254386353131)
        fresh = ~np.isin(pair(nbrs), pair(g.nbrs)) & (nbrs >= 0)
        return graph_row(g.number, g.nodes, g.vecs, nbrs, sims, fresh).append_column("n_fresh", pa.array([int(fresh.sum())], pa.int64()))

    return pin(graph.groupBy("bucket").cogroup(better.groupBy("bucket")).applyInArrow(merge, GRAPH + ", n_fresh long"))


def build_graph(nodes: DataFrame, k: int = K, bucket_nodes: int = BUCKET_NODES, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """The neighbour graph of ``nodes`` (node, vec; distinct), by bucket, and the number of buckets."""
    n = nodes.count()
    n_buckets = max(1, math.ceil(n / bucket_nodes))
    graph = start_graph(nodes, n, n_buckets, k)
    for turn in range(max_rounds if n > 1 else 0):
        before, graph = graph, descend(graph, n_buckets, k, turn)
        unpin(before)
        if (graph.agg(F.sum("n_fresh")).first()[0] or 0) <= SETTLED * n * min(k, n - 1):
            break
    return graph, n_buckets


STATE = "bucket int, q long, vec binary, ids binary, sims binary, done binary, lists binary, seen binary"
ASK = "bucket int, q long, vec binary, least float, ids binary"
TOLD = "bucket int, q long, ids binary, sims binary, lists binary"


def search(graph: DataFrame, n_buckets: int, wanted: DataFrame, k: int = K, beam: int = BEAM, expand: int = EXPAND, steps: int = STEPS) -> DataFrame:
    """(q, node) for the ``beam`` nodes found best for each node q of ``wanted`` (node), itself not among them."""

    def home(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            ids = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(ids, n_buckets).astype(np.int32)), pa.array(ids)], ["bucket", "q"])

    def begin(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """A query's first beam is the list of its node.  Their own lists are not known yet, so all are asked for again."""
        if not rows.num_rows or not queries.num_rows:
            return table_of([])
        g = Bucket(rows)
        out = []
        for q in queries["q"].to_pylist():
            i = int(g.place(np.int64(q)))
            out.append((g.number, q, g.vecs[i], np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool), np.empty((0, k), np.int64), np.array([q], np.int64), g.nbrs[i]))
        return table_of(out, first=True)

    def table_of(states: list[tuple], first: bool = False) -> pa.Table:
        schema = {"bucket": pa.int32(), "q": pa.int64(), **{c: pa.binary() for c in ("vec", "ids", "sims", "done", "lists", "seen")}}
        columns = {c: [] for c in schema}
        for st in states:
            # The nodes to ask next are kept as the lists of a beam of one, not done.
            if first:
                st = (*st[:3], np.array([-1], np.int64), np.array([-np.inf], np.float32), np.array([False]), st[8].reshape(1, -1), st[7])
            for c, x in zip(columns, st, strict=True):
                columns[c].append(x.tobytes() if isinstance(x, np.ndarray) else x)
        return pa.table({c: pa.array(columns[c], t) for c, t in schema.items()})

    def opened(st: dict) -> tuple[np.ndarray, ...]:
        ids, sims, done = np.frombuffer(st["ids"], np.int64), np.frombuffer(st["sims"], np.float32), np.frombuffer(st["done"], bool)
        return ids, sims, done, np.frombuffer(st["lists"], np.int64).reshape(-1, k), np.frombuffer(st["seen"], np.int64)

    def next_nodes(st: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places in the beam to expand, and their neighbours not asked for so far."""
        ids, _, done, lists, seen = opened(st)
        grow = np.flatnonzero(~done)[:expand]
        new = np.setdiff1d(lists[grow], seen)
        return grow, new[new >= 0]

    def ask(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            out: dict[str, list] = {"bucket": [], "q": [], "vec": [], "least": [], "ids": []}
            for st in batch.to_pylist():
                _, new = next_nodes(st)
                sims = np.frombuffer(st["sims"], np.float32)
                order, bounds = split_by(bucket_of(new, n_buckets), n_buckets)
                for b in np.flatnonzero(np.diff(bounds)):
                    out["bucket"].append(int(b))
                    out["q"].append(st["q"])
                    out["vec"].append(st["vec"])
                    out["least"].append(float(sims[-1]) if len(sims) >= beam else -math.inf)
                    out["ids"].append(new[order[bounds[b] : bounds[b + 1]]].tobytes())
            types = (pa.int32(), pa.int64(), pa.binary(), pa.float32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types, strict=True)], list(out))

    def tell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "q": [], "ids": [], "sims": [], "lists": []}
        if asked.num_rows:
            g = Bucket(rows)
            for r in asked.to_pylist():
                at = g.place(np.frombuffer(r["ids"], np.int64))
                sims = g.vecs[at] @ np.frombuffer(r["vec"], np.float32)
                good = sims > r["least"]
                at, sims = at[good], sims[good]
                if len(at):
                    out["bucket"].append(int(bucket_of(np.array([r["q"]]), n_buckets)[0]))
                    out["q"].append(r["q"])
                    out["ids"].append(g.nodes[at].tobytes())
                    out["sims"].append(sims.astype(np.float32).tobytes())
                    out["lists"].append(g.nbrs[at].tobytes())
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), types, strict=True)})

    def step(states: pa.Table, told: pa.Table) -> pa.Table:
        answers: dict[int, list[dict]] = {}
        for r in told.to_pylist():
            answers.setdefault(r["q"], []).append(r)
        out = []
        for st in states.to_pylist():
            ids, sims, done, lists, seen = opened(st)
            grow, new = next_nodes(st)
            done = done.copy()
            done[grow] = True
            real = ids >= 0
            got = answers.get(st["q"], [])
            ids = np.concatenate([ids[real], *(np.frombuffer(r["ids"], np.int64) for r in got)])
            sims = np.concatenate([sims[real], *(np.frombuffer(r["sims"], np.float32) for r in got)])
            lists = np.concatenate([lists[real].reshape(-1, k), *(np.frombuffer(r["lists"], np.int64).reshape(-1, k) for r in got)])
            done = np.concatenate([done[real], np.zeros(len(ids) - int(real.sum()), bool)])
            order = np.lexsort((ids, -sims))[:beam]
            vec = np.frombuffer(st["vec"], np.float32)
            out.append((st["bucket"], st["q"], vec, ids[order], sims[order], done[order], lists[order], np.concatenate([seen, new])))
        return table_of(out)

    queries = wanted.select("node").mapInArrow(home, "bucket int, q long")
    state = pin(graph.groupBy("bucket").cogroup(queries.groupBy("bucket")).applyInArrow(begin, STATE))
    for _ in range(steps):
        told = graph.groupBy("bucket").cogroup(state.mapInArrow(ask, ASK).groupBy("bucket")).applyInArrow(tell, TOLD)
        before, state = state, pin(state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(step, STATE))
        unpin(before)

    def found(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
            q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([np.empty(0, np.int64), *ids]))], ["q", "node"])

    return state.mapInArrow(found, "q long, node long").where("node >= 0")


def scaled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, vec) with all vectors times one power of two that brings the largest component to 0.5 to 1, so no product overflows and order stays."""
    most = nodes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double")))))).first()[0]
    by = F.lit(2.0 ** -math.frexp(most)[1])
    return nodes.select("node", F.transform("vec", lambda x: (x.cast("double") * by).cast("float")).alias("vec"))


def nearest(vectors: DataFrame, top: int = 20, every: int = 20, vec_id: str = "vec_id", vec: str = "embedding", k: int = K, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """For rows whose id is divisible by ``every``: query_id, rank, vec_id and score of the ``top`` nearest found, by inner product.

    Candidates are all rows but the query's own; score is the inner product of the
    original vectors in double precision, ties go to the smaller id; with fewer
    candidates all come, if the graph leads to them.  The graph compares in single
    precision, all vectors scaled alike.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; vectors must have one length.  Repeated rows
    (same id and vector) count once.  Other columns are not read.  Nothing in, or a
    single vector, gives no rows.
    """
    value = F.transform(F.col(vec), lambda x: x.cast("float"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), value.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = pin(rows.where(F.coalesce(whole, F.lit(False))).distinct())
    # Of a vector's copies the top + 1 smallest ids can be in an answer.
    small = top_n(rows, ["vec"], [F.col("vec_id")], top + 1, spread=F.col("vec_id"))
    nodes = pin(small.groupBy("vec").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    if nodes.isEmpty():
        return nodes.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    queries = pin(rows.where(F.col("vec_id") % every == 0).join(nodes.select("vec", "node"), "vec").select(F.col("vec_id").alias("query_id"), "node"))
    graph, n_buckets = build_graph(scaled(nodes), k, bucket_nodes)
    pairs = search(graph, n_buckets, queries.select("node").distinct(), k)
    asked = queries.select(F.col("node").alias("q")).distinct()
    pairs = pairs.union(asked.select("q", F.col("q").alias("node")))  # a vector's copies are candidates too
    left = nodes.select(F.col("node").alias("q"), F.col("vec").alias("u"))
    product = F.aggregate(F.zip_with("u", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scores = pairs.join(left, "q").join(nodes, "node").select("q", "node", "ids", product.alias("score"))
    nearer = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    scores = scores.withColumn("_n", F.row_number().over(nearer)).where(F.col("_n") <= top + 1).drop("_n")
    lists = scores.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("found"))
    ids = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("id")))))
    answer = queries.join(lists.withColumnRenamed("q", "node"), "node").select("query_id", F.filter(F.array_sort(ids), lambda x: x["id"] != F.col("query_id")).alias("all"))
    out = answer.select("query_id", F.posexplode(F.slice("all", 1, top)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
