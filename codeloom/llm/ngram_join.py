"""Jaccard self-join of word n-gram sets with prefix trees, to connected components.

One global order holds everywhere: frequent shingles last, ties by hash. Two sets that link share one of the first
p(n) = n - ceil(t * n) + 1 shingles of each (the prefix), and l of the first p(n) - 1 + l. So a document takes part only if at
least p(ceil(t * n)) of its first 2 * p(n) - 1 shingles are found in other documents, which chance alone hardly brings about,
and only documents that share a prefix shingle meet. Sets that meet go into
a trie in the reverse order, frequent shingles first, where similar sets share their upper path; a probe walks the trie
once for all of them, counts the overlap as it goes, and leaves a subtree as soon as what remains on either side can no
longer make a link, or when the whole subtree is already in the probe's component.

Components are all that is asked for, so work is spent only between components: (1) each set meets others in its most
shared prefix shingle alone, in blocks; what may still link across components is then gathered, closed under shared prefix shingles
and near sizes; (2) in a large gathering a few delegates of each component meet, and what is still apart is told apart by bit
sketches, so that it falls into small ones; (3) all members of a gathering meet those of its other components, block by block
where it is large. Nothing is skipped that could be a link between two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, enter, leave, worker_cache

#: A shingle in more than one of so many documents counts as frequent; at most FREQUENT * (mean set size) shingles are.
FREQUENT = 512
#: Sets that one group holds; more of them meet block against block.
BLOCK = 256
#: Shingles that one group holds (4 MB): sets of long documents meet in smaller blocks, so a group's memory doesn't follow their length.
SHINGLES = 1 << 19
#: Sketches that one group holds on a side: about 1 bit for each shingle of a set, so these are a 64th of the sets.
SKETCHES = 1024
#: A shingle of at most so many documents names its pairs.
FEW = 8
_EMPTY = np.zeros(0, np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()
worker_cache("ngrams", _words.clear)


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word n-grams of a whole text, A-Z lowered.

    With fewer words than `width` the whole sequence is one shingle; without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return _EMPTY
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        width, h = len(h), h ^ _C  # apart from full shingles
    x = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        x = (x ^ h[i : len(h) - width + 1 + i]) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return np.unique(x ^ (x >> np.uint64(30)))


def _sign(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _scan(width: int):
    """kind 0: a document with the size and signature of its set. kind 1: a shingle that is frequent in a block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngrams")
        seen, block = set(), []

        def batch_of(kind, a, n, s1, s2):
            k = len(a)
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], names=["kind", "id", "n", "s1", "s2"])

        def frequent():
            t, c = np.unique(np.concatenate(block), return_counts=True)
            many = c >= max(3, len(block) // (FREQUENT // 2))
            t, c = t[many].view(np.int64), c[many]
            return batch_of(1, t, c, c, c)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), width)
                sign = _sign(s)
                rows.append((doc, len(s), *sign))
                if len(s) and sign not in seen:
                    seen.add(sign)
                    block.append(s)
                    if len(block) == 1500:
                        yield frequent()
                        block, seen = [], set()
            if rows:
                yield batch_of(0, *zip(*rows, strict=True))
        if len(block) > 2:
            yield frequent()
        block, seen = [], set()
        leave()

    return run


class Order:
    """The global order: shingles outside the table first, by hash; those inside by count, then hash."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        at = np.argsort(shingle)
        self.shingle, self.count = shingle[at], count[at]

    def counts(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        return np.where(self.shingle[at] == s, self.count[at], 0)

    def sort(self, s: np.ndarray) -> np.ndarray:
        """Indices that put s (ascending hashes) into the order."""
        return np.argsort(self.counts(s), kind="stable")


def _prefixes(width: int, percent: int, order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngrams")
        seen = set()
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                tokens, signs, sizes, cores, hots = [], [], [], [], []
                for text in batch.column(0).slice(part, 500).to_pylist():
                    s = shingles(text, width)
                    if not len(s):
                        continue
                    sign = _sign(s)
                    if sign in seen:
                        continue
                    if len(seen) > 150_000:
                        seen.clear()
                    seen.add(sign)
                    p = prefix_length(len(s), percent)
                    counts = order.counts(s)
                    first = np.argsort(counts, kind="stable")[: 2 * p - 1]  # as order.sort()
                    tokens.append(s[first])
                    hots.append(counts[first] > 0)
                    signs.append((*sign, len(s)))
                    sizes.append(len(tokens[-1]))
                    cores.append(np.arange(len(tokens[-1])) < p)
                if tokens:
                    wide = np.repeat(np.array(signs, np.int64), sizes, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.ascontiguousarray(wide[:, i])) for i in range(3)), pa.array(np.concatenate(cores)), pa.array(np.concatenate(hots))], names=["token", "s1", "s2", "n", "core", "hot"])
        seen = set()
        leave()

    return run


def sketch(s: np.ndarray, bits: int) -> bytes:
    """Parities of the shingles that fall on each of so many bits (a power of 2). Two sketches differ in at most as many bits as
    their sets differ in shingles, as each such shingle turns one bit over."""
    at = (s >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_bits(size_class: int, percent: int) -> int:
    """Bits for the sets of a class and the one below: a power of 2, at least the largest set, so that unrelated sets differ in
    about half of the bits."""
    return 1 << max(8, math.ceil((size_class + 1) * math.log2(100 / percent) * 1.000001))


def may_link(sketches: np.ndarray, nodes: np.ndarray, components: np.ndarray, sizes: np.ndarray, classes: np.ndarray, sides: np.ndarray, top: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of nodes, a spanning forest of those whose sketches (a row of 64-bit words each) leave a link possible.

    Only nodes of different components are compared, of which one at least is of the class `top`, and where there are two
    sides only those of different ones."""
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs, two = [], len(np.unique(sides)) > 1
    at = np.lexsort((sizes, sides))
    sketches, nodes, components, sizes, classes, sides = (x[at] for x in (sketches, nodes, components, sizes, classes, sides))
    half = int(np.searchsorted(sides, sides[0], "right"))
    for i in range(half if two else len(nodes)):
        # sets that link have sizes within percent of each other, so a stretch of the other rows, which ascend by size
        first, last = (half, len(nodes)) if two else (i + 1, len(nodes))
        low = first + int(np.searchsorted(sizes[first:last], -(-sizes[i] * percent // 100)))
        high = first + int(np.searchsorted(sizes[first:last], sizes[i] * 100 // percent, "right"))
        if low >= high:
            continue
        differ = np.bitwise_count(sketches[low:high] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        most = (100 - percent) * (sizes[low:high] + sizes[i]) // (100 + percent)
        hit = (differ <= most) & (components[low:high] != components[i])
        if classes[i] != top:
            hit &= classes[low:high] == top
        for j in (np.flatnonzero(hit) + low).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                pairs.append((int(nodes[i]), int(nodes[j])))
    return pairs


class _Node:
    __slots__ = ("edge", "children", "low", "high", "member", "mixed", "records")

    def __init__(self, edge: np.ndarray, member: int, size: int):
        self.edge, self.children, self.low, self.high = edge, {}, size, size
        self.member, self.mixed, self.records = member, False, []


class Trie:
    """Path-compressed prefix tree of ascending integer arrays, with the sizes below each node and a component if all share one."""

    def __init__(self, percent: int, find):
        self.root, self.percent, self.find = None, percent, find

    def insert(self, x: np.ndarray, who: int) -> None:
        size, at, n = len(x), 0, len(x)
        if self.root is None:
            self.root = _Node(x[:0], who, size)
        node = self.root
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            node.mixed = node.mixed or self.find(node.member) != self.find(who)
            if at == n:
                node.records.append((who, size))
                return
            first = int(x[at])
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = _Node(x[at:], who, size)
                child.records.append((who, size))
                return
            m = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:m] != x[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.edge):  # cut the edge
                upper = _Node(child.edge[:same], child.member, child.low)
                upper.high, upper.mixed = child.high, child.mixed
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = upper
                child = upper
            node, at = child, at + same

    def probe(self, x: np.ndarray, who: int) -> Iterator[int]:
        """Members of other components whose sets link with x. The caller unites them at once, which prunes what follows."""
        if self.root is None:
            return
        n, find, percent = len(x), self.find, self.percent
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, at, both, theirs = stack.pop()
            if not node.mixed and find(node.member) == find(who):
                continue
            edge = node.edge
            if len(edge):
                place = np.searchsorted(x, edge)
                both_here = int(np.count_nonzero(x[np.minimum(place, n - 1)] == edge))
                at = int(np.searchsorted(x, edge[-1], "right"))
                both, theirs = both + both_here, theirs + len(edge) - both_here
            mine = at - both
            # 100 * o >= percent * (n + m - o), with o at most n - mine and at most m - theirs, for some size m below here
            if (100 + percent) * (n - mine) < percent * (n + node.low) or 100 * node.high - percent * n < (100 + percent) * theirs:
                continue
            for other, size in node.records:
                if 100 * both >= percent * (n + size - both) and find(other) != find(who):
                    yield other
            stack.extend((c, at, both, theirs) for c in node.children.values())


def link_group(sets: list[np.ndarray], components: list[int], sides: list[int], percent: int, order: Order) -> list[tuple[int, int]]:
    """Pairs of components to unite: a spanning forest of the links among the sets of one group.

    sides: with two values present only sets of different sides are compared, else all."""
    token = np.concatenate(sets)
    token.sort()
    token = token[np.append(True, token[1:] != token[:-1])]
    rank = np.empty(len(token), np.int32)
    rank[order.sort(token)] = np.arange(len(token) - 1, -1, -1, dtype=np.int32)  # frequent first
    own = [np.sort(rank[np.searchsorted(token, s)]) for s in sets]  # set by set: a group is never held in several forms at once
    del token, rank
    parent: dict[int, int] = {c: c for c in components}

    def find_component(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def find(i: int) -> int:
        return find_component(components[i])

    trie, pairs = Trie(percent, find), []
    left, two = min(sides), len(set(sides)) > 1
    for i in sorted(range(len(sets)), key=lambda i: (sides[i], len(sets[i]), i)):
        if not two or sides[i] != left:
            for j in trie.probe(own[i], i):
                a, b = sorted((find(i), find(j)))
                if a != b:
                    parent[b] = a
                    pairs.append((a, b))
        if not two or sides[i] == left:
            trie.insert(own[i], i)
    return pairs


def _several(rows: DataFrame) -> DataFrame:
    """Rows whose token more than one signature has.

    A token of the global order is one that many sets have, which is known from counting it there: its rows stay, and are dealt
    by signature besides. Any other token has less than a FREQUENT-th part of all sets or so, and is seen by one task."""
    w = Window.partitionBy("token", F.when(F.col("hot"), F.pmod("s1", F.lit(256))).otherwise(0))
    differ = (F.min("s1").over(w) != F.max("s1").over(w)) | (F.min("s2").over(w) != F.max("s2").over(w))
    return rows.withColumn("several", F.col("hot") | differ).where("several").drop("several")


def _with_counts(rows: DataFrame, keys: list[str], **counts: Column) -> DataFrame:
    """rows, a table, with aggregates of their group. Groups of hot tokens are summed up in parts and joined, as are all groups where
    rows don't say what is hot; any other token's rows are few enough for one task, which spares a second exchange."""
    warm = rows.where("hot") if "hot" in rows.columns else rows
    summed = warm.join(warm.groupBy(*keys).agg(*(c.alias(n) for n, c in counts.items())), keys).select(*rows.columns, *counts)
    if "hot" not in rows.columns:
        return summed
    w = Window.partitionBy(*keys)
    return rows.where("NOT hot").select("*", *(c.over(w).alias(n) for n, c in counts.items())).unionByName(summed)


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, label) for the nodes of edges (a, b); label is the least node of the component. None without edges.

    Every node points to its least neighbour, pointers are followed to their end over two hops, and the edges between the
    remaining roots make the next, smaller round; all of it stays in tables."""
    e = scratch.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while e.take(1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        up = scratch.table(up, "pointers")
        for _ in range(2):
            hop = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            up = up.join(hop, "label").select("node", F.col("next").alias("label"))
        up = scratch.table(up, "labels")
        step = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
        total = up if total is None else scratch.table(total.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")).unionByName(up.join(total, "node", "left_anti")), "total")
        to_a, to_b = (up.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b"))
        e = scratch.table(e.join(to_a, "a").join(to_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "edges")
    return total


def components(docs: DataFrame, scratch: Scratch, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest doc_id
    reachable. Empty sets link with nothing. A row without doc_id takes no part: its component_id is null. Rows that
    repeat a doc_id are one node, joined whatever their texts. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scratch.table(docs.mapInArrow(_scan(width), "kind int, id long, n long, s1 long, s2 long"), "scan")
    light = scanned.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "s1", "s2")
    nodes = scratch.table(light.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "nodes")
    n_nodes = nodes.count()
    # At most FREQUENT * (mean set size) rows reach the driver: each stands for n_nodes / FREQUENT shingles of the corpus.
    frequent = scanned.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, n_nodes // FREQUENT)).toPandas()
    order = Order(frequent["id"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64))

    raw = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_prefixes(width, percent, order), "token long, s1 long, s2 long, n long, core boolean, hot boolean")
    least = F.expr(f"(({percent} * n + 99) DIV 100) - ({percent} * (({percent} * n + 99) DIV 100) + 99) DIV 100 + 1")

    def in_company(rows: DataFrame, name: str) -> DataFrame:
        """Rows of shingles that several documents have, of documents with enough of them."""
        rows = scratch.table(_several(rows).distinct(), name)
        enough = rows.groupBy("s1", "s2", "n").count().where(F.col("count") >= least).select("s1", "s2")
        return rows.join(enough, ["s1", "s2"])

    first_pass = in_company(raw, "shared-1")
    company = scratch.table(in_company(first_pass, "shared-2").join(nodes.drop("n"), ["s1", "s2"]), "company")
    core = scratch.table(company.where("core").drop("core"), "core")
    shared = scratch.table(_with_counts(core, ["token"], df=F.count("*"), mass=F.sum("n"), low=F.min("node"), high=F.max("node")).where("low <> high").drop("low", "high", "hot"), "shared")

    # Sets of the documents that meet another one at all; everything else is done.
    chosen = shared.groupBy("node", "s1", "s2").agg(F.max(F.struct("df", "token", "mass")).alias("top"), F.max("n").alias("n")).select("node", "s1", "s2", "n", "top.df", "top.mass", "top.token")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngrams")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingles(t, width) for t in some.column(some.num_columns - 1).to_pylist()]
                keep = pa.array([_sign(s) == (a, b) for s, a, b in zip(sets, some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*batch.schema.names[:-1], "shingles"]).filter(keep)
        leave()

    chosen_texts = chosen.join(docs.withColumnRenamed("doc_id", "node"), "node")
    sets = scratch.table(chosen_texts.mapInArrow(to_sets, "node long, s1 long, s2 long, n long, df long, mass long, token long, shingles binary"), "sets")

    def link(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("component", "side")}
        pairs = link_group([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")], rows["component"], rows["side"], percent, order) if table.num_rows > 1 else []
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        if table.num_rows > BLOCK // 2 or table.nbytes > 4 * SHINGLES:
            rows = None
            leave()
        return pa.Table.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def linked(groups: DataFrame, *key: str) -> DataFrame:
        return groups.groupBy(*key).applyInArrow(link, "a long, b long")

    def relabel(current: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        new = connected(edges, scratch)
        if new is None:
            return current
        new = new.withColumnRenamed("node", "component")
        return scratch.table(current.join(new, "component", "left").select("node", F.coalesce("label", "component").alias("component")), name)

    def blocks_of(df: Column, mass: Column) -> Column:
        """Blocks for so many sets that hold so many shingles."""
        return F.greatest(F.ceil(df / BLOCK), F.ceil(mass / SHINGLES)).cast("int")

    deal = F.pmod(F.xxhash64("node"), blocks_of(F.col("df"), F.col("mass"))).cast("int")
    first = sets.withColumn("component", F.col("node")).withColumn("side", F.lit(0)).withColumn("block", deal)
    own = scratch.table(chosen.select("node").distinct().withColumn("component", F.col("node")), "own")
    current = relabel(own, linked(first.select("token", "block", "component", "side", "shingles"), "token", "block"), "round-1")

    def gatherings() -> DataFrame:
        """super, node, component, size: the documents that may still link across components, in closed gatherings.

        Two documents may link only if their sizes lie within a class of each other and they share at least `least` of
        their first shingles. Shingles of few documents name the pairs that share them, so those are counted exactly
        (at most FEW - 1 for each row); shingles of many can add no more than either document has. Pairs that reach
        `least`, and whoever could reach it through shingles of many alone, are joined up; each set then travels once."""
        rows = company.join(current, "node").withColumn("own", own_class).withColumn("least", least)
        rows = rows.select("token", "node", "component", "core", "own", "least", "hot")  # the exchanges below carry nothing else
        rows = rows.withColumn("class", F.explode(F.array(F.col("own"), F.col("own") + 1)))  # a key of class c holds sizes of classes c - 1 and c
        span = {"low": F.min("component"), "high": F.max("component")}
        rows = scratch.table(rows, "keys")
        rows = scratch.table(_with_counts(rows, ["token", "class"], df=F.count("*"), **span).where("low <> high").drop("low", "high"), "open")
        per_node = rows.groupBy("node").agg(F.countDistinct("token").alias("all"), F.countDistinct(F.when(F.col("df") > FEW, F.col("token"))).alias("many"), F.min("least").alias("least"))
        per_node = scratch.table(per_node.where(F.col("all") >= F.col("least")).drop("all", "least"), "nodes-open")
        rows = rows.join(per_node, "node")
        one = F.struct("node", "component", "many", "least", "own")
        small = rows.where(F.col("df") <= FEW).groupBy("token", "class").agg(F.array_sort(F.collect_list(one)).alias("x"))
        pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, FEW), lambda q: F.struct(p.alias("p"), q.alias("q")))))
        pairs = small.select("class", F.explode(pairs).alias("pair")).select("class", "pair.p", "pair.q").where("p.component <> q.component AND greatest(p.own, q.own) = class")
        pairs = pairs.groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count("*").alias("c"), F.max(F.least("p.many", "q.many")).alias("many"), F.max(F.greatest("p.least", "q.least")).alias("least"))
        pairs = scratch.table(pairs, "pairs-open")
        best = pairs.select(F.col("a").alias("node"), "c").unionByName(pairs.select(F.col("b").alias("node"), "c")).groupBy("node").agg(F.max("c").alias("best"))
        large = rows.where(F.col("core") & (F.col("df") > FEW)).join(best, "node", "left").where(F.col("many") + F.coalesce("best", F.lit(0)) >= F.col("least"))
        large = _with_counts(scratch.table(large, "large"), ["token", "class"], hub=F.min("node"), **span).where("low <> high")
        stars = large.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        edges = scratch.table(pairs.where(F.col("c") + F.col("many") >= F.col("least")).select("a", "b").unionByName(stars), "edges-open")
        labels = connected(edges, scratch)
        touched = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        labels = touched.withColumn("label", F.col("node")) if labels is None else labels
        members = scratch.table(rows.select("node", "component").distinct().join(labels.withColumnRenamed("label", "super"), "node"), "members")
        return scratch.table(_with_counts(members, ["super"], size=F.count("*")), "gatherings")

    def to_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                node, n, own, data = (c.to_pylist() for c in batch.slice(at, 500).columns)
                rows = [(i, k, o, c, sketch(np.frombuffer(d, np.uint64), sketch_bits(c, percent))) for i, k, o, d in zip(node, n, own, data, strict=True) for c in (o, o + 1)]
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "n", "own", "class", "sketch"])
        leave()

    def compare(table: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        pairs = may_link(words, *(table.column(c).to_numpy() for c in ("node", "component", "n", "own", "side")), table.column("class")[0].as_py(), percent) if table.num_rows > 1 else []
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.Table.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def told_apart(members: DataFrame) -> DataFrame:
        """super, node, component: members of large gatherings in smaller ones, closed as well: two documents of different
        components whose sketches leave a link possible stay together. A pair meets in the class of its larger set."""
        members = members.select("super", "node", "component")
        wide = members.select("node").join(with_sets, "node").withColumn("n", F.expr("octet_length(shingles) DIV 8"))
        drawn = wide.withColumn("own", own_class).select("node", "n", "own", "shingles").mapInArrow(to_sketches, "node long, n long, own int, class int, sketch binary")
        drawn = scratch.table(drawn, "sketches")
        keys = scratch.table(drawn.select("node", "n", "own", "class").join(members, "node"), "sketch-keys")
        keys = _with_counts(keys, ["super", "class"], df=F.count("*"), top=F.max("own"), low=F.min("component"), high=F.max("component"))
        keys = keys.where("low <> high AND top = class").withColumn("blocks", F.ceil(F.col("df") / SKETCHES).cast("int"))
        keys = keys.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = keys.select("super", "class", "node", "component", "n", "own", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
        met = keys.join(drawn.select("node", "n", "class", "sketch"), ["node", "n", "class"])
        edges = scratch.table(met.groupBy("super", "class", "left", "right").applyInArrow(compare, "a long, b long"), "edges-sketched")
        labels = connected(edges, scratch)
        if labels is None:
            return members.where("false")
        return members.drop("super").join(labels.withColumnRenamed("label", "super"), "node").select("super", "node", "component")

    own_class = F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).cast("int")
    with_sets = sets.select("node", "shingles")
    lengths = sets.select("node", "n")
    gathered = gatherings()
    if gathered.where(F.col("size") > BLOCK).take(1):  # a few members of each component meet first, which settles most of a large one
        some = Window.partitionBy("super", "component").orderBy(F.xxhash64("node"), "node")
        few = gathered.where(F.col("size") > BLOCK).withColumn("k", F.row_number().over(some)).where("k <= 3")
        few = scratch.table(few.drop("k", "size").join(lengths, "node"), "few")
        few = _with_counts(few, ["super"], df=F.count("*"), mass=F.sum("n")).withColumn("block", deal).withColumn("side", F.lit(0))
        met = few.join(with_sets, "node")
        current = relabel(current, linked(met.select("super", "block", "component", "side", "shingles"), "super", "block"), "round-2")
        # Gatherings stay closed; only the components in them are fewer now.
        def apart(members: DataFrame) -> DataFrame:
            found = _with_counts(scratch.table(members, "members"), ["super"], size=F.count("*"), low=F.min("component"), high=F.max("component"))
            return scratch.table(found.where("low <> high").drop("low", "high"), "gatherings")

        gathered = apart(gathered.drop("component", "size").join(current, "node"))
        if gathered.where(F.col("size") > BLOCK).take(1):
            gathered = apart(gathered.where(F.col("size") <= BLOCK).select("super", "node", "component").unionByName(told_apart(gathered.where(F.col("size") > BLOCK))))

    # All pairs of different components of a gathering meet: blocks of the largest component with blocks of the others.
    gathered = scratch.table(gathered.join(lengths, "node"), "gathered")
    sizes = gathered.groupBy("super", "component").agg(F.count("*").alias("count"), F.sum("n").alias("mass"))
    most = sizes.groupBy("super").agg(F.max(F.struct("count", "component", "mass")).alias("m"), F.sum("count").alias("n_all"), F.sum("mass").alias("all_mass"))
    large = (F.col("n_all") > BLOCK) | (F.col("all_mass") > SHINGLES)
    most = most.select("super", "n_all", "all_mass", F.when(large, F.col("m.component")).alias("main"), *(F.when(large, F.col(f"m.{c}")).otherwise(0).alias(to) for c, to in (("count", "n_main"), ("mass", "main_mass"))))
    rest = gathered.drop("size").join(most, "super").withColumn("of_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    blocks = blocks_of(F.col("n_all") - F.col("n_main"), F.col("all_mass") - F.col("main_mass"))
    rest = rest.withColumn("blocks", blocks).withColumn("main_blocks", blocks_of(F.col("n_main"), F.col("main_mass")))
    side = F.when(F.col("of_main"), F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    partners = F.when(F.col("of_main"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") + F.col("main_blocks") - 1))
    rest = rest.withColumn("side", side).withColumn("other", F.explode(partners))
    rest = rest.select("super", "node", "component", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    met = rest.join(with_sets, "node")
    current = relabel(current, linked(met.select("super", "left", "right", "component", "side", "shingles"), "super", "left", "right"), "round-3")

    found = scratch.table(nodes.join(current, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component")), "found")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return light.join(found.hint("merge"), ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op9_ngram_components(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark, "ngrams"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(reach) FROM r WHERE r.node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
