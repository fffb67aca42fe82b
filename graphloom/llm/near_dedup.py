"""Near-duplicate documents by a chosen-path set similarity join.

Every text becomes its set of word shingles.  Texts with the same set are one class.  Classes are branched down
independent trees: a node picks two of the minwise coordinates at random (by a hash of the node), and sends each
class to the child named by its value there.  Classes that are alike follow the same path with a probability of
their similarity at each step, so a pair at 0.8 survives a two-branch tree of any depth with at least 0.93, and
four trees miss less than one such pair in ten thousand.  Small nodes are compared exhaustively.

What the trees find are families: classes joined by pairs that the minwise estimate doesn't exclude (five standard deviations
below the threshold).  Large groups of near copies would fill nodes that no branching makes small, so large first nodes elect
typical members by their commonest coordinate values, twice; what is alike to one of these is a family before
the trees are grown.  Nodes that hold one family are done, nodes with few members outside their largest family compare
those with all of them in blocks, and only the rest is branched.

Links are then decided within families on the full shingle sets: intersections of all pairs of a cell are one product of
0/1 matrices, and only a spanning forest leaves the task.  A large family is cut into blocks that share its most typical members;
what isn't linked with those is compared with the whole family, block by block.  No pair within a family is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, col, fresh, small_enough
from .components import connected_components
from .shingles import minima, multipliers, shingles

COORDINATES, TREES, BRANCHES, LEVELS, LEAF = 128, 4, 2, 8, 1024
#: Elections of typical members in large first nodes; members outside a node's largest family up to which it is compared in blocks.
ELECTIONS, OUTSIDE = 2, 4096
#: Members of a cell, shingles of a cell, typical members of a group, and coordinates by which they are found.
BLOCK, CELL_SHINGLES, TYPICAL, MODE_COORDINATES = 512, 2_000_000, 3, 16
#: Rows that may be broadcast: classes that pick their texts, at some 70 bytes each; typical members, at some 300; ids of rows that go, at some 16.
MOST_BROADCAST, MOST_TYPICAL, MOST_IDS = 500_000, 50_000, 2_000_000


def _features(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = multipliers(COORDINATES, seed)
        for batch in batches:
            ids, n, digest, branch, sig = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    digest.append(None), branch.append(None), sig.append(None)
                    continue
                low = minima(s, a, b)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                branch.append(low[: TREES * BRANCHES].astype(np.int64).tolist())
                sig.append(low.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(branch, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "class", "branch", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, COORDINATES)


def _likely(least: float):
    """Keeps (a, b) whose signatures agree in at least that share of coordinates."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = _agreements(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
                yield batch.select(["a", "b"]).filter(pa.array(same >= np.ceil(least * COORDINATES)))

    return run


class _Forest:
    """Union-find over a cell's rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _cells(batches, width: int) -> Iterator[tuple[bytes, list[tuple]]]:
    """Rows arrive sorted by their first column: one list for each value of it."""
    cell, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True):
            if row[0] != cell and rows:
                yield cell, rows
                rows = []
            cell = row[0]
            rows.append(row)
    if rows:
        yield cell, rows


def _pairs_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])
    found.clear()
    return out


def _compare_leaves(least: float):
    """cell, side, label, sig: emits pairs of labels that a likely pair of rows joins, a forest of them for each cell.

    side 0: compared with all of its cell; 1 and 2: rows of 1 are compared with rows of 2.
    """

    def run(batches):
        found = []
        for _, rows in _cells(batches, 4):
            if len(rows) < 2:
                continue
            sig = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(-1, COORDINATES)
            names, label = np.unique(np.array([r[2] for r in rows], object), return_inverse=True)
            side, root = np.array([r[1] for r in rows]), np.arange(len(names))
            right, least_same = np.flatnonzero(side == 2), np.ceil(least * COORDINATES)
            for i in np.flatnonzero(side != 2):
                mine = root[label[i]]
                others = np.arange(i + 1, len(rows)) if side[i] == 0 else right
                others = others[root[label[others]] != mine]  # the rest is joined already
                if len(others):
                    alike = others[_agreements(sig[others], sig[i]) >= least_same]
                    for r in np.unique(root[label[alike]]):
                        found.append((names[mine], names[r]))
                        root[root == r] = mine
            if len(found) > 20_000:
                yield _pairs_batch(found)
        yield _pairs_batch(found)

    return run


def _agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of a agrees with b (or its row of b): bytes 0 and 1 summed eight at a time."""
    lanes = (a == b).view(np.uint64).sum(axis=1, dtype=np.uint64)
    return ((lanes & np.uint64(0x00FF00FF00FF00FF)) + ((lanes >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))) * np.uint64(0x0001000100010001) >> np.uint64(48)


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y (but of a set with itself), as products of 0/1 matrices over what both sides have."""
    out = np.zeros((len(x), len(y)), np.int64)
    if not x or not y:
        return out
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    known = np.intersect1d(flat_x, flat_y)
    if len(x) == len(y) and all(p is q for p, q in zip(x, y, strict=True)):  # what one set has alone counts for no pair
        known, times = np.unique(flat_x, return_counts=True)
        known = known[times > 1]
    of = lambda flat, sets: (np.searchsorted(known, flat), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (cx, rx), (cy, ry) = of(flat_x, x), of(flat_y, y)
    okx, oky = cx < len(known), cy < len(known)
    okx[okx] = known[cx[okx]] == flat_x[okx]
    oky[oky] = known[cy[oky]] == flat_y[oky]
    cx, rx, cy, ry = cx[okx], rx[okx], cy[oky], ry[oky]
    for at in range(0, len(known), 4096):
        a, b = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        m, n = (cx >= at) & (cx < at + 4096), (cy >= at) & (cy < at + 4096)
        a[rx[m], cx[m] - at] = 1
        b[ry[n], cy[n] - at] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def _decide(words: int, percent: int):
    """cell, side, class, label, text: confirmed links on full sets, a forest of them for each cell; see _compare_leaves() for side.

    Rows of one label are known to be joined already.  The forest's links point to the least class of its tree where side is 0.
    """

    def run(batches):
        found = []
        for _, rows in _cells(batches, 5):
            if len(rows) < 2:
                continue
            sets = [shingles(r[4], words) for r in rows]
            size = np.array([len(s) for s in sets])
            side = np.array([r[1] for r in rows])
            label = np.unique(np.array([r[3] for r in rows], object), return_inverse=True)[1]
            left = np.flatnonzero(side != 2)
            right = np.flatnonzero(side != 1) if (side == 0).any() else np.flatnonzero(side == 2)
            both = _intersections([sets[i] for i in left], [sets[j] for j in right])
            ok = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            ok &= label[left][:, None] != label[right][None, :]
            forest = _Forest(len(rows))
            for i, j in zip(*np.nonzero(ok), strict=True):
                i, j = int(left[i]), int(right[j])
                x, y = rows[i][2], rows[j][2]
                if x != y and forest.union(i, j):
                    found.append((x, y) if x > y else (y, x))
            if len(found) > 20_000:
                yield _pairs_batch(found)
        yield _pairs_batch(found)

    return run


def least_estimate(percent: int) -> float:
    """The minwise estimate that a pair needs to join a family: five of its standard deviations below the threshold."""
    t = percent / 100
    return max(0.0, t - 5 * (t * (1 - t) / COORDINATES) ** 0.5)


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, seed: int):
        self.work = Workspace(docs.sparkSession, "near-dedup")
        self.words, self.percent = words, percent
        self.least = least_estimate(percent)
        self.rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
        self.features = self.work.save(self.rows.mapInArrow(_features(words, seed), "doc_id long, n_shingles long, class binary, branch array<long>, sig binary"), "features")

    def classes(self) -> DataFrame:
        """One row per distinct set: its smallest id, and what the trees need."""
        named = self.features.where("n_shingles > 0 and doc_id is not null")
        first = named.groupBy("class").agg(F.min(F.struct("doc_id", "branch", "sig")).alias("r"))
        return self.work.save(first.select("class", "r.*"), "classes")

    def run(self) -> DataFrame:
        w = self.work
        classes = self.classes()
        self._repeated = w.save(self.features.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"), "repeated")
        if not classes.take(1):
            return self.result(classes.select("class", F.col("class").alias("root")))
        families = self.families(classes)
        links = self.links(families, classes)
        roots = w.save(connected_components(links, w).toDF("class", "root"), "roots")
        return self.result(classes.select("class").join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("root")))

    # ---- families -------------------------------------------------------------------------------------------------

    def families(self, classes: DataFrame) -> DataFrame:
        """class, family: joined by likely pairs."""
        w, sig = self.work, classes.select("class", "sig")
        first = classes.select("class", F.posexplode("branch").alias("j", "v"))
        shared = first.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
        placed = w.save(first.join(shared, ["j", "v"]).select(F.xxhash64("j", "v").alias("node"), "j", "class", "n"), "placed")
        labels = self.elected(placed, sig)
        named = placed.select("node", "class")
        named = named.withColumn("label", F.col("class")) if labels is None else named.join(labels, "class", "left").select("node", "class", F.coalesce("label", "class").alias("label"))
        pairs = self.joined(w.save(named, "named"), sig)
        if labels is not None:
            pairs = pairs.unionByName(labels.select(F.col("class").alias("a"), F.col("label").alias("b")))
        families = connected_components(pairs, w).toDF("class", "family")
        w.drop(placed)
        return w.save(families, "families")

    def elected(self, placed: DataFrame, sig: DataFrame) -> DataFrame | None:
        """class, label: what is alike to typical members of large first nodes, which stand for one tree's first branch each time."""
        w, up = self.work, None
        for j in range(ELECTIONS):
            crowd = placed.where(f"j = {j} and n > {LEAF}")
            if up is not None:  # only what has no family yet
                crowd = crowd.join(up.select(F.col("a").alias("class")).distinct(), "class", "left_anti")
                crowd = crowd.join(crowd.groupBy("node").count().where(f"count > {LEAF}").select("node"), "node", "left_semi")
            crowd = w.save(crowd.select(F.col("node").alias("family"), "class").join(sig, "class"), "crowd")
            if not crowd.take(1):
                break
            heads = w.save(self.typical(crowd).join(sig, "class").select("family", F.col("class").alias("b"), F.col("sig").alias("sig_b")), "heads")
            heads = F.broadcast(heads) if small_enough(heads, MOST_TYPICAL) else heads
            met = crowd.select("family", F.col("class").alias("a"), F.col("sig").alias("sig_a")).join(heads, "family").where("a <> b")
            alike = w.save(met.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(self.least), "a binary, b binary"), "alike")
            w.drop(crowd)
            up = alike if up is None else up.unionByName(alike)
        return None if up is None or not up.take(1) else w.save(connected_components(up, w).toDF("class", "label"), "labels")

    def joined(self, placed: DataFrame, sig: DataFrame) -> DataFrame:
        """Pairs of labels that likely pairs join, found down the trees."""
        w, cells = self.work, []
        for level in range(LEVELS):
            about = w.save(placed.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("node", "n"), "mixed")
            members = placed.join(about, "node")
            if level == 0:
                members = members.join(sig, "class")
            members = w.save(members.select("node", "class", "label", "sig", "n"), "members")
            cells.append(members.where(f"n <= {LEAF}").select(F.col("node").alias("cell"), F.lit(0).alias("side"), "class", "label", "sig"))
            large = members.where(f"n > {LEAF}")
            if not large.take(1):
                break
            by = large.groupBy("node", "label").agg(F.count("*").alias("c"))
            main = w.save(by.groupBy("node").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n_")).select("node", F.col("m.label").alias("main"), F.lit(None).cast("long").alias("size"), "n_", (F.col("n_") - F.col("m.c")).alias("others")), "main")
            last = level == LEVELS - 1
            cells.append(self.grid(large.drop("n"), main if last else main.where(f"others <= {OUTSIDE}"), "node", "sig"))
            rest = large.join(main.where(f"others > {OUTSIDE}").select("node"), "node", "left_semi")
            if last or not rest.take(1):
                break
            children = []
            for k in range(BRANCHES):
                j = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int")
                children.append(F.xxhash64("node", j, F.substring("sig", 1 + 2 * j, F.lit(2))))
            placed = w.save(rest.select(F.explode(F.array(*children)).alias("node"), "class", "label", "sig"), "placed")
        out = cells[0]
        for more in cells[1:]:
            out = out.unionByName(more)
        out = out.select("cell", "side", "label", "sig").repartition("cell").sortWithinPartitions("cell")
        return w.save(out.mapInArrow(_compare_leaves(self.least), "a binary, b binary").distinct(), "joined")

    @staticmethod
    def grid(rows: DataFrame, main: DataFrame, key: str, payload: str) -> DataFrame:
        """The members outside a group's main label against all of it, in blocks: cell, side, class, label, payload.

        main: key, main, n_, others, and the members' size in all (null: no matter).
        """
        blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.coalesce(F.ceil(F.col("size") * F.col(n) / F.col("n_") / CELL_SHINGLES), F.lit(1)), F.lit(1)).cast("int")
        rows = rows.join(main.select(key, "main", blocks("n_").alias("nb"), blocks("others").alias("nr")), key)
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        every = rows.select("*", F.pmod(F.xxhash64("class", F.lit(7)), F.col("nb")).cast("int").alias("y"), spread("nr").alias("x"), F.lit(2).alias("side"))
        rest = rows.where("label <> main").select("*", spread("nb").alias("y"), F.pmod(F.xxhash64("class", F.lit(8)), F.col("nr")).cast("int").alias("x"), F.lit(1).alias("side"))
        return every.unionByName(rest).select(F.xxhash64(key, "x", "y").alias("cell"), "side", "class", "label", payload)

    # ---- links ----------------------------------------------------------------------------------------------------

    def links(self, families: DataFrame, classes: DataFrame) -> DataFrame:
        """Confirmed links (a, b) that connect what all confirmed links within families connect."""
        w = self.work
        n_shingles = self.features.where("n_shingles > 0").groupBy("class").agg(F.max("n_shingles").alias("k"))
        sized = families.join(n_shingles, "class").groupBy("family").agg(F.count("*").alias("n"), F.sum("k").alias("size"))
        sized = w.save(sized, "sized")
        members = w.save(families.join(sized, "family").join(classes.select("class", "doc_id", "sig"), "class"), "members")
        texts = self.texts(members)
        big = f"n > {BLOCK} or size > {CELL_SHINGLES}"
        own = F.col("class").alias("label")
        small = texts.where(f"not ({big})").select(F.xxhash64("family").alias("cell"), F.lit(0).alias("side"), "class", own, "text")
        large = members.where(big)
        if not large.take(1):
            return self.decided(small)
        typical = w.save(self.typical(large), "typical")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / CELL_SHINGLES)).cast("int")
        held = texts.where(big).withColumn("nb", blocks)
        mine = held.select(F.xxhash64("family", F.pmod(F.xxhash64("class", F.lit(7)), F.col("nb")).cast("int")).alias("cell"), F.lit(0).alias("side"), "class", own, "text")
        shared = held.join(typical.select("class"), "class", "left_semi").select(F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"), "family", "class", "text")
        shared = shared.select(F.xxhash64("family", "y").alias("cell"), F.lit(0).alias("side"), "class", own, "text")
        one = self.decided(small.unionByName(mine).unionByName(shared))
        # what the typical members didn't join with most of its family meets all of it
        joined = connected_components(one, w).toDF("class", "root")
        labelled = w.save(held.select("class", "family", "n", "size").join(w.save(joined, "joined"), "class", "left").select("class", "family", "n", "size", F.coalesce("root", "class").alias("label")), "labelled")
        by = labelled.groupBy("family", "label", "n", "size").agg(F.count("*").alias("c"))
        main = by.groupBy("family").agg(F.max(F.struct("c", "label")).alias("m"), F.max("n").alias("n_"), F.max("size").alias("size")).select("family", F.col("m.label").alias("main"), "size", "n_", (F.col("n_") - F.col("m.c")).alias("others")).where("others > 0")
        main = w.save(main, "main")
        if not main.take(1):
            return one
        again = held.select("class", "family", "text").join(labelled.select("class", "label"), "class")
        return one.unionByName(self.decided(self.grid(again, main, "family", "text")))

    def decided(self, cells: DataFrame) -> DataFrame:
        out = cells.select("cell", "side", "class", "label", "text").repartition("cell").sortWithinPartitions("cell")
        return self.work.save(out.mapInArrow(_decide(self.words, self.percent), "a binary, b binary").distinct(), "links")

    def texts(self, members: DataFrame) -> DataFrame:
        """members' family, n, size, class, text.  Only the texts of classes that have company travel."""
        asked = members.select("doc_id", "class", "family", "n", "size")
        texts = self.rows.join(F.broadcast(asked) if small_enough(asked, MOST_BROADCAST) else asked, "doc_id")
        # rows that share an id may differ in text: only the one of this class counts
        repeats = not small_enough(self._repeated, 0)
        texts = texts.mapInArrow(_own_text(self.words, repeats), "class binary, family binary, n long, size long, text string")
        return self.work.save(texts.dropDuplicates(["class"]) if repeats else texts, "texts")

    def typical(self, members: DataFrame) -> DataFrame:
        """family, class: the members that agree in most coordinates with their family's commonest values."""
        values = members.select("family", "class", F.transform(F.sequence(F.lit(0), F.lit(MODE_COORDINATES - 1)), lambda j: F.substring("sig", 1 + 2 * j, F.lit(2))).alias("values"))
        counts = values.select("family", F.posexplode("values").alias("j", "v")).groupBy("family", "j", "v").agg(F.count("*").alias("c"))
        modes = counts.groupBy("family", "j").agg(F.max(F.struct("c", "v")).alias("m")).groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m.v"))), lambda x: x["v"]).alias("mode"))
        modes = self.work.save(modes, "modes")
        near = values.join(modes, "family").select("family", "class", F.aggregate(F.zip_with("values", "mode", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x).alias("same"))
        # the best of some independent shares of each family
        best = near.groupBy("family", F.pmod(F.xxhash64("class", F.lit(5)), F.lit(TYPICAL)).alias("g")).agg(F.max(F.struct("same", "class")).alias("m"))
        return best.select("family", F.col("m.class").alias("class"))

    def result(self, roots: DataFrame) -> DataFrame:
        """doc_id, n_shingles, class, component_id, kept for each row."""
        w = self.work
        ids = self.features.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
        rooted = w.save(roots.join(ids, "class"), "rooted")
        least = w.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
        of = w.save(rooted.join(least, "root").select("class", "component_id"), "of")
        linked = self.features.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "class").join(of, "class")
        alone = self.features.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id"))
        return linked.unionByName(alone).select("doc_id", "n_shingles", "class", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _own_text(words: int, repeats: bool):
    def run(batches):
        import xxhash

        for batch in batches:
            out = batch.select(["class", "family", "n", "size", "text"])
            if repeats:
                own = [xxhash.xxh3_128_digest(shingles(t.as_py(), words).tobytes()) == c.as_py() for t, c in zip(batch.column("text"), batch.column("class"), strict=True)]
                out = out.filter(pa.array(own, pa.bool_()))
            yield out

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, class, component_id, kept: one row for each row of docs.

    Words: runs of anything but ASCII white space, A-Z lower-cased.  Linked: 100 * intersection >= percent * union of
    the shingle sets.  component_id: the smallest id that links reach; kept: that is the row's own id.
    Null and blank texts have no shingles and no links.  Rows with a null id take no part: component_id null, kept.
    Rows that repeat an id are documents of their own; equal rows have equal results (and are all kept or all not).
    An empty table gives an empty table; other columns are not read.
    """
    return _Join(docs, id_col, text_col, words, percent, seed).run()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates: of each component one row stays, one with the smallest id.

    Rows that can't be linked (null or blank text, null id) all stay.  Of rows with one id and one text, one stays;
    rows with one id and different texts stay if one of them would.
    """
    work = Workspace(docs.sparkSession, "near-dedup-rows")
    found = work.save(near_duplicates(docs, id_col, text_col, words, percent), "found")
    named = found.where("doc_id is not null")
    id_, text = (fresh(docs, f"gl_{x}") for x in ("id", "text"))
    per_id = named.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    odd = work.save(per_id.where("n > 1 or not kept"), "ids")

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if small_enough(ids, MOST_IDS) else ids

    own = [col(c) for c in docs.columns]
    # ids with a blank row are kept, so whole ids can go; this is the only join that may have to move the rows
    left = docs.select(*own, col(id_col).cast("long").alias(id_)).join(few(odd.where("not kept").select(id_)), id_, "left_anti")
    many = odd.where("n > 1 and kept").select(id_)
    if not many.take(1):
        return left.select(*own)
    # ids on several rows: each different text once
    blank = ~F.coalesce(F.regexp_like(col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    again = left.where(~blank).join(few(many), id_, "left_semi")
    plain = left.where(blank).unionByName(left.where(~blank).join(few(many), id_, "left_anti"))
    order = F.struct(*[col(c) for c in docs.columns if not dict(docs.dtypes)[c].startswith(("map", "variant"))])
    once = again.groupBy(id_, col(text_col).alias(text)).agg(F.min_by(F.struct(*own), order).alias("row_")).select("row_.*")
    return plain.select(*own).unionByName(once)
