"""Exact Jaccard self-join on word shingles with a token-group matrix.

Documents with equal shingle sets are one class, joined through its smallest id.  The
classes are partitioned into groups of similar documents, and the matrix keeps, for each
group, the union of its members' tokens.  A query can only be linked with a member if
the union holds three quarters of the query's tokens; the other groups stay closed.

Which (query, group) cells of the matrix need a look follows from prefixes: in any
global token order, two linked documents share a token among their first quarter.
The order puts rare tokens first, with counts over all documents, so that passages that
many documents share rarely enter a prefix; the order decides the cost, never the result.

1. ``document_facts``: set sizes, set digests and 32-bit token fingerprints.
2. Frequent fingerprints, counted in ranges, are put last in the order.
3. Prefix tokens are sorted; documents are grouped beside the first document that they
   share most prefix tokens with.  A family too large for one group is cut into parts,
   after its documents were held against the first one.
4. Documents whose prefix tokens occur in other groups ask these groups.  Members and
   queries that have too few prefix tokens in common with anyone there are let go; the
   others are held against the union, and groups that qualify are opened.
5. Components of all links.

Cases: a document without words has an empty set and its own component; null ids get a
null component and link with nothing; rows that repeat a doc_id are one node, linked by
any of their texts, and are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm import shared
from tarnlight.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tokens of this many documents are put last in the token order, MOST_FREQUENT of them at most.
FREQUENT, MOST_FREQUENT = 32, 2_000_000
#: Fingerprints that one task counts at once, about.
RANGE_TOKENS = 4_000_000
#: Fingerprints below this are counted; bits of the map of those seen twice, as a power of 2.
COUNTED, MAP_BITS = 1 << 31, 30
#: First documents of a family that its others are held against before it is cut.
LEADERS = 8
#: Members and tokens of a group's part; larger families are cut by a hash.
GROUP, GROUP_TOKENS = 1024, 1 << 20
_GAP = 65535


def shingle_sets(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes."""
    words = shared.Words(column, shared.SPACED)
    grams = shared.gram_hashes(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(shared.mixed(shared.gram_hashes(words.hash[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n must share with any set it is linked with."""
    return -(-PERCENT * n // 100)


def _gaps(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as 16-bit differences; 65535 only moves on."""
    step = np.diff(values.astype(np.int64), prepend=0)
    more = step // _GAP
    out = np.full(len(step) + int(more.sum()), _GAP, np.uint16)
    out[np.cumsum(more + 1) - 1] = step % _GAP
    return out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != _GAP]


def document_facts(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of two kinds: a document's set size and digest, or a range's token fingerprints."""

    def flush(held: list[np.ndarray]):
        prints = np.concatenate(held) >> np.uint64(32)
        prints = np.sort(prints[prints < COUNTED].astype(np.uint32))
        width = COUNTED // ranges
        cuts = np.searchsorted(prints, np.arange(ranges + 1, dtype=np.int64) * width)
        for r in range(ranges):
            if cuts[r + 1] > cuts[r]:
                yield r, _gaps(prints[cuts[r] : cuts[r + 1]].astype(np.int64) - r * width)

    def ranged(held):
        rows = list(flush(held))
        n = len(rows)
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["doc", "n", "d1", "d2", "range", "prints"])

    def work(stream):
        held, count = [], 0
        for batch in stream:
            for part in shared.slices(batch):
                sets = shingle_sets(part.column("text"))
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[::2]), pa.array(digests[1::2]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc", "n", "d1", "d2", "range", "prints"])
                held += sets
                count += sum(map(len, sets))
                if count > 2_000_000:
                    yield ranged(held)
                    held, count = [], 0
        if count:
            yield ranged(held)

    return docs.mapInArrow(work, "doc long, n long, d1 long, d2 long, range int, prints binary")


@dataclass
class Counted:
    """What the fingerprints' counts say: the frequent ones, and a bit map of those seen twice."""

    prints: np.ndarray
    docs: np.ndarray
    bits: np.ndarray
    shift: int

    def order(self, tokens: np.ndarray) -> np.ndarray:
        """Ascending hashes in the global order: frequent tokens last, by their counts."""
        if not len(self.prints):
            return tokens
        short = (tokens >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.prints, short), len(self.prints) - 1)
        common = np.where(self.prints[at] == short, self.docs[at], 0)
        return tokens[np.argsort(common, kind="stable")] if common.any() else tokens

    def twice(self, tokens: np.ndarray) -> np.ndarray:
        """False for tokens that only one document has; true for some of these, too."""
        short = (tokens >> np.uint64(32)).astype(np.int64)
        bit = np.minimum(short, COUNTED - 1) >> self.shift
        return (short >= COUNTED) | ((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def count_tokens(facts: DataFrame, ranges: int) -> Counted:
    """Counts over all documents, for the lower half of the fingerprints.

    Tokens of the upper half stand behind those of the lower half in the order as long
    as half of a document's tokens are rare, so their counts hardly matter.  The counts
    stay a table; a scale of them says from which number of documents on at most
    MOST_FREQUENT prints remain, and only these and a map of 2**MAP_BITS bits reach the
    driver.  With more tokens than that the map only becomes less selective.
    """
    width = COUNTED // ranges
    total = facts.agg(F.sum("n")).first()[0] or 0
    shift = max(0, 31 - min(MAP_BITS, max(10, int(total).bit_length())))
    shift = min(shift, width.bit_length() - 4)  # a range has whole bytes of the map

    def steps(n):
        """Numbers of documents on a logarithmic scale, eight steps to a doubling."""
        return np.minimum((8 * np.log2(n)).astype(np.int64), 511)

    def count(key, rows):
        at = key[0].as_py()
        values, n = np.unique(np.concatenate([_from_gaps(b) for b in rows.column("prints").to_pylist()]), return_counts=True)
        held = np.zeros(width >> shift, np.uint8)
        held[values[n > 1] >> shift] = 1
        keep = n >= FREQUENT
        prints = (values[keep] + at * width).astype(np.uint32)
        scale = np.bincount(steps(n[keep]), minlength=512).tolist()
        return pa.table({"range": pa.array([at], pa.int32()), "prints": [prints.tobytes()], "docs": [n[keep].astype(np.int32).tobytes()], "bits": [np.packbits(held, bitorder="little").tobytes()], "scale": pa.array([scale], pa.list_(pa.int64()))})

    found = facts.filter("range IS NOT NULL").select("range", "prints").groupBy("range").applyInArrow(count, "range int, prints binary, docs binary, bits binary, scale array<long>")
    found = shared.stored(found, "counted")
    scale = np.zeros(512, np.int64)
    for r in found.select(F.posexplode("scale").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect():
        scale[r["step"]] = r["n"]
    # the least step from which on all prints together are not too many
    over = np.flatnonzero(np.cumsum(scale[::-1]) > MOST_FREQUENT)
    least = 512 - int(over[0]) if len(over) else 0

    def cut(stream):
        for batch in stream:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], np.int32)
                keep = steps(docs) >= least if len(docs) else np.zeros(0, bool)
                prints = np.frombuffer(row["prints"], np.uint32)[keep]
                yield pa.RecordBatch.from_arrays([pa.array([row["range"]], pa.int32()), *[pa.array([x], pa.binary()) for x in (prints.tobytes(), docs[keep].tobytes(), row["bits"])]], ["range", "prints", "docs", "bits"])

    rows = found.drop("scale").mapInArrow(cut, "range int, prints binary, docs binary, bits binary").collect()
    bits = np.zeros(COUNTED >> shift + 3, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["range"] * len(own) : (r["range"] + 1) * len(own)] = own
    prints = np.frombuffer(b"".join(bytes(r["prints"]) for r in rows), np.uint32)
    docs = np.frombuffer(b"".join(bytes(r["docs"]) for r in rows), np.int32)
    order = np.argsort(prints)
    return Counted(prints[order], docs[order], bits, shift)


def prefixes(docs: DataFrame, held) -> DataFrame:
    """(token, n, doc, pos): the prefix tokens of each document that another may have.

    ``held`` is what ``count_tokens`` gives, broadcast.
    """

    def work(stream):
        seen = held.value
        for batch in stream:
            for part in shared.slices(batch):
                tokens, docs_of, sizes, places = [], [], [], []
                for doc, own in zip(part.column("doc").to_pylist(), shingle_sets(part.column("text"))):
                    n = len(own)
                    if not n:
                        continue
                    prefix = seen.order(own)[: n - needed(n) + 1]
                    pos = np.flatnonzero(seen.twice(prefix))
                    tokens.append(prefix[pos])
                    docs_of.append(np.full(len(pos), doc, np.int64))
                    sizes.append(np.full(len(pos), n, np.int32))
                    places.append(pos.astype(np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(docs_of)), pa.array(np.concatenate(places))], ["token", "n", "doc", "pos"])

    return docs.mapInArrow(work, "token long, n int, doc long, pos int")


def may_link(n1, p1, n2, p2):
    """Whether sets of these sizes can be linked if their first common token has these places."""
    most = 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
    return (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def shared_tokens(rows: DataFrame) -> DataFrame:
    """Prefix rows of tokens with several documents, and the first document of each token.

    Sorted rows stream through with the first row of the current token as the only
    state, so a token may have any number of documents.
    """

    def work(stream):
        names = ("token", "n", "doc", "pos")
        first = last = None  # the first row of the last row's token; the last row, not yet emitted
        for batch in stream:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols)]
            token = cols[0]
            fresh = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), 0))
            hub = [c[start] for c in cols]
            joined = np.concatenate([~fresh[1:], [False]]) | ~fresh
            if first is not None:
                for h, x in zip(hub, first):
                    h[token == first[0]] = x
                joined[0] |= first != last
            yield from emit(cols, hub, joined, len(token) - 1)
            first, last = [int(h[-1]) for h in hub], [int(c[-1]) for c in cols]
        if last is not None and first != last:
            yield from emit([np.array([x]) for x in last], [np.array([x]) for x in first], np.array([True]), 1)

    def emit(cols, hub, joined, upto):
        pick = np.flatnonzero(joined[:upto])
        if len(pick):
            _, n, doc, pos = (c[pick] for c in cols)
            _, hn, hdoc, hpos = (c[pick] for c in hub)
            near = may_link(n, pos, hn, hpos) & (doc != hdoc)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][pick]), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(hdoc), pa.array(near)], ["token", "n", "doc", "pos", "hub", "near"])

    spread = rows.repartition("token").sortWithinPartitions("token", "n", "doc")
    return spread.mapInArrow(work, "token long, n int, doc long, pos int, hub long, near boolean")


def open_groups(docs: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (a, b) inside groups, and of queries with members of the groups they ask.

    ``members`` is (group, part, doc, known), ``queries`` (group, part, doc).  Members of
    one ``known`` number are linked already.  Of all links only those are returned that
    join what is apart so far, so a group gives fewer links than it has documents.
    """
    cell = lambda role, known: F.struct("group", "part", F.lit(role).alias("role"), known.alias("known"))
    asked = members.select("doc", cell(0, F.col("known")).alias("c")).unionByName(queries.select("doc", cell(1, F.col("doc")).alias("c")))
    per_doc = shared.stored(asked.groupBy("doc").agg(F.collect_set("c").alias("cells")), "cells")
    weight = per_doc.agg(F.sum(F.size("cells") * 28 + 40)).first()[0] or 0
    side = F.broadcast(per_doc) if weight <= shared.BROADCAST_BYTES else per_doc.hint("merge")
    wanted = docs.join(side, "doc").select("doc", "text", "cells")
    names = ["group", "part", "role", "doc", "known", "tokens"]

    def packed(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    def ship(stream):
        for batch in stream:
            for part in shared.slices(batch):
                out, size = [[] for _ in names], 0
                for doc, own, cells in zip(part.column("doc").to_pylist(), shingle_sets(part.column("text")), part.column("cells").to_pylist()):
                    raw = own.tobytes()
                    for c in cells:
                        for col, v in zip(out, (c["group"], c["part"], c["role"], doc, c["known"], raw)):
                            col.append(v)
                        size += len(raw)
                        if size > 8 << 20:
                            yield packed(out)
                            out, size = [[] for _ in names], 0
                yield packed(out)

    def compare(stream):
        group = matrix = None
        held: list[tuple[int, int, np.ndarray]] = []
        for batch in stream:
            links: list[tuple[int, int]] = []
            for g, p, role, doc, known, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                if (g, p) != group:
                    if matrix is None and held:
                        links += Group(held).inner_links()
                    group, held, matrix = (g, p), [], None
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    held.append((doc, known, own))
                elif held:
                    if matrix is None:
                        matrix = Group(held)
                        links += matrix.inner_links()
                    links += matrix.query_links(doc, own)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
        if matrix is None and held:
            links = Group(held).inner_links()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    cells = wanted.mapInArrow(ship, "group long, part long, role int, doc long, known long, tokens binary")
    return cells.repartition("group", "part").sortWithinPartitions("group", "part", "role", "doc").mapInArrow(compare, "a long, b long")


def common_needed(n1, n2):
    """Prefix tokens that linked sets of these sizes must have in common.

    Of the needed common tokens the x-th stands at most x places plus the set's other
    tokens from the front, so this many of them lie in both prefixes.
    """
    both = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    return np.maximum(1, both + 1 - np.maximum(needed(n1), needed(n2)))


def screened(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, part, role, doc, known): the members and queries that may have a partner in their cell.

    ``cells`` has the same columns, role 0 for members and 1 for queries.  The prefix
    tokens decide, which are far smaller than the sets.
    """
    prefix = rows.groupBy("doc").agg(F.when(F.min("n") == F.max("n"), F.max("n")).otherwise(-1).cast("long").alias("n"), F.array_sort(F.collect_set("token")).alias("tokens"))
    names = ["group", "part", "role", "doc", "known"]

    class Cell:
        def __init__(self, members):
            self.n = np.array([m[2] for m in members], np.int64)
            self.known = np.array([m[1] for m in members], np.int64)
            tokens = np.concatenate([m[3] for m in members])
            owner = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])
            order = np.argsort(tokens, kind="stable")
            self.tokens, start = np.unique(tokens[order], return_index=True)
            self.start, self.owner = np.append(start, len(tokens)), owner[order]

        def partners(self, n, known, tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            at = at[self.tokens[at] == tokens]
            many = self.start[at + 1] - self.start[at]
            base = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) if len(at) else np.zeros(0, np.int64)
            both = np.bincount(self.owner[base + np.arange(len(base))], minlength=len(self.n))
            fit = (both >= common_needed(n, self.n)) & (100 * np.minimum(n, self.n) >= PERCENT * np.maximum(n, self.n))
            return ((both > 0) & (fit | (n < 0) | (self.n < 0))) & (self.known != known)

    def work(stream):
        cell, held, matrix, used = None, [], None, None

        def close():
            """The members that are still wanted, once the cell is over."""
            m = matrix or Cell(held)
            hit = np.zeros(len(held), bool) if used is None else used
            for i, (_, known, n, tokens) in enumerate(held):
                if len(held) > 1 and not hit[i]:
                    mine = m.partners(n, known, tokens)
                    mine[i] = False
                    if mine.any():
                        hit[i] = True
                        hit |= mine
            return [(*cell, 0, held[i][0], held[i][1]) for i in np.flatnonzero(hit)]

        for batch in stream:
            out = []
            tokens, offsets = batch.column("tokens"), batch.column("tokens").offsets.to_numpy()
            flat = tokens.values.to_numpy() if batch.num_rows else None
            for i, (g, p, role, doc, known, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*names, "n"]))):
                own = flat[offsets[i] : offsets[i + 1]]
                if (g, p) != cell:
                    if held:
                        out += close()
                    cell, held, matrix, used = (g, p), [], None, None
                if role == 0:
                    held.append((doc, known, n, own.copy()))
                elif held:
                    if matrix is None:
                        matrix, used = Cell(held), np.zeros(len(held), bool)
                    mine = matrix.partners(n, known, own)
                    if mine.any():
                        used |= mine
                        out.append((g, p, 1, doc, known))
            yield made(out)
        if held:
            yield made(close())

    def made(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return cells.join(prefix, "doc").select(*names, "n", "tokens").repartition("group", "part").sortWithinPartitions("group", "part", "role", "doc").mapInArrow(work, "group long, part long, role int, doc long, known long")


class Group:
    """One column of the token-group matrix: the members' token union, and who has each token."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.docs = np.array([m[0] for m in members])
        self.sets = [m[2] for m in members]
        self.sizes = np.array([len(x) for x in self.sets])
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")  # owners stay ascending within a token
        self.union, self.start = np.unique(tokens[order], return_index=True)
        self.start = np.append(self.start, len(tokens))
        self.owner = owner[order]
        self.root = list(range(len(members)))
        first: dict[int, int] = {}
        for i, m in enumerate(members):
            self._join(i, first.setdefault(m[1], i))

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _join(self, i: int, j: int) -> bool:
        i, j = self._find(i), self._find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j

    def partners(self, query: np.ndarray) -> np.ndarray:
        """Members that are linked with the query; the group stays closed if its union forbids any."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if 100 * len(at) < PERCENT * len(query):
            return np.zeros(0, np.int64)
        many = self.start[at + 1] - self.start[at]
        base = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        both = np.bincount(self.owner[base + np.arange(int(many.sum()))], minlength=len(self.docs))
        return np.flatnonzero(100 * both >= PERCENT * (len(query) + self.sizes - both))

    def inner_links(self) -> list[tuple[int, int]]:
        links = []
        parts = len({self._find(i) for i in range(len(self.docs))})
        for i, own in enumerate(self.sets):
            if parts == 1:
                break
            for j in self.partners(own).tolist():
                if self._join(i, j):
                    links.append((int(self.docs[i]), int(self.docs[j])))
                    parts -= 1
        return links

    def query_links(self, doc: int, query: np.ndarray) -> list[tuple[int, int]]:
        links, met = [], set()
        for j in self.partners(query).tolist():
            root = self._find(j)
            if root not in met and self.docs[j] != doc:
                met.add(root)
                links.append((doc, int(self.docs[j])))
        return links


def contested(rows: DataFrame) -> DataFrame:
    """(doc, group, part): which cells outside its own a document must ask.

    ``rows`` is (token, n, doc, pos, group, part, known).  Two documents that share a
    prefix token are compared in the cell of the one with the smaller label, asked by the
    other.  A cell's documents at a token are bounded together, by their range of sizes
    and first place, so the work is documents times cells, not pairs.
    """
    names = ("token", "n", "doc", "pos", "group", "part", "known")

    def cells_of(run):
        n, doc, pos, group, part, known = run
        # rows are sorted by group and part: a cell is a run of rows
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
        if fresh.sum() == 1:
            return None
        begin = np.flatnonzero(fresh)
        own = np.cumsum(fresh) - 1
        low, high, first = np.minimum.reduceat(n, begin), np.maximum.reduceat(n, begin), np.minimum.reduceat(pos, begin)
        ka, kb = np.minimum.reduceat(known, begin), np.maximum.reduceat(known, begin)
        found = []
        step = max(1, 4_000_000 // len(begin))
        for a in range(0, len(n), step):
            q = slice(a, a + step)
            nq, pq = n[q, None], pos[q, None]
            most = 1 + np.minimum(nq - 1 - pq, high - 1 - first)
            ok = (np.arange(len(begin)) < own[q, None]) & (100 * high >= PERCENT * nq) & (100 * nq >= PERCENT * low) & ((100 + PERCENT) * most >= PERCENT * (nq + np.minimum(low, nq)))
            ok &= ~((ka == kb) & (ka == known[q, None]))
            i, j = np.nonzero(ok)
            if len(i):
                found.append(np.unique(np.stack([doc[q][i], group[begin[j]], part[begin[j]]], 1), axis=0))
        return np.concatenate(found) if found else None

    def distinct(found):
        return np.unique(np.concatenate(found), axis=0)

    def made(found):
        rows = distinct(found) if found else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], ["doc", "group", "part"])

    def work(stream):
        held, current, found, size = [], None, [], 0
        for batch in stream:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            cut = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(cols[0]))):
                if held and cols[0][a] != current:
                    cells = cells_of([np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0])
                    if cells is not None:
                        found.append(cells)
                        size += len(cells)
                    held = []
                    if size > 1_000_000:  # a document meets a cell at many tokens
                        found = [distinct(found)]
                        size = len(found[0])
                        if size > 500_000:
                            yield made(found)
                            found, size = [], 0
                current = cols[0][a]
                held.append([c[a:b] for c in cols[1:]])
        if held:
            cells = cells_of([np.concatenate(x) for x in zip(*held)])
            if cells is not None:
                found.append(cells)
        yield made(found)

    spread = rows.select(*names).repartition("token").sortWithinPartitions("token", "group", "part")
    return spread.mapInArrow(work, "doc long, group long, part long").distinct()


def families(rows: DataFrame) -> DataFrame:
    """(doc, n, lead, group): documents beside a document that they share tokens with.

    Of the first documents of its tokens (a tenth of them at least) a document follows
    the one that most documents know, so that similar documents follow the same;
    ``group`` is the document at the end of eight such steps.  Any grouping gives the
    same links, good ones give small unions.
    """
    votes = rows.groupBy("doc", "hub").agg(F.count("*").alias("votes"), F.max("n").cast("long").alias("n"))
    votes = shared.stored(votes, "votes")
    known = votes.groupBy("hub").agg(F.count("*").alias("size")).withColumn("known", F.col("size"))
    rated = shared.join_groups(votes, known, ["hub"], "size")
    best = rated.groupBy("doc").agg(F.max("n").alias("n"), F.sum("votes").alias("all"), F.collect_list(F.struct("known", (-F.col("hub")).alias("hub"), "votes")).alias("hubs"))
    lead = -F.array_max(F.filter("hubs", lambda x: 10 * x["votes"] >= F.col("all")))["hub"]
    best = shared.stored(best.select("doc", "n", F.coalesce(lead, F.col("doc")).alias("lead")), "leads")
    step = best.select("doc", F.col("lead").alias("group"))
    for _ in range(3):  # each time twice as far
        ahead = step.select(F.col("doc").alias("group"), F.col("group").alias("next"))
        step = step.join(ahead, "group", "left").select("doc", F.coalesce("next", "group").alias("group"))
    return best.join(step, "doc")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    shared.tune(spark)
    own = shared.ids_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "doc")
    # a range of fingerprints is counted in one task: about one token to six bytes, half of them
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << min(20, max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, size // 12 // RANGE_TOKENS).bit_length())
    facts = shared.stored(document_facts(own, ranges), "shingle-facts")
    sized = facts.filter("n IS NOT NULL").select("doc", "n", "d1", "d2")
    full = sized.filter("n > 0 AND doc IS NOT NULL")
    classes = full.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    member = shared.stored(shared.join_groups(full, classes, ["d1", "d2"], "copies").select("doc", "n", "rep"), "classes")
    nodes = member.groupBy("doc").agg(F.max(F.col("doc") == F.col("rep")).alias("leads"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    twice = nodes.filter("lo <> hi").select(F.col("doc").alias("a"), "lo", "hi")
    joined = twice.select("a", F.col("lo").alias("b")).unionByName(twice.select("a", F.col("hi").alias("b")))

    reps = shared.without_ids(own.filter("doc IS NOT NULL"), nodes.filter("NOT leads").select(F.col("doc").alias("drop_id")), "doc")
    held = spark.sparkContext.broadcast(count_tokens(facts, ranges))
    rows = shared.stored(shared_tokens(prefixes(reps, held)), "shared-tokens")
    held.destroy()
    family = shared.stored(families(rows), "families")
    sizes = family.groupBy("group").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("long").alias("parts"))
    placed = shared.stored(shared.join_groups(family, shared.stored(sizes, "family-sizes"), ["group"], "size"), "placed")
    first = F.lit(-1).cast("long").alias("part")
    # families of several parts are first held against the documents that lead most others
    wide = placed.filter("parts > 1")
    if wide.limit(1).count():
        popular = wide.groupBy("group", F.col("lead").alias("doc")).agg(F.count("*").alias("led"))
        popular = popular.withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("led"), "doc"))).filter(F.col("nth") <= LEADERS)
        star = shared.stored(open_groups(reps, popular.select("group", first, "doc", F.col("doc").alias("known")), wide.select("group", first, "doc")), "links-star")
        led = shared.stored(components(star), "led")
        sizes = led.groupBy("component").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / GROUP).cast("long"))
        led = shared.join_groups(led, sizes, ["component"], "size").select(F.col("node").alias("doc"), F.col("component").alias("known"), F.col("parts").alias("cuts"))
    else:
        star = spark.createDataFrame([], "a long, b long")
        led = spark.createDataFrame([], "doc long, known long, cuts long")
    # what they link is a group by itself, known to be connected; the rest stays with its lead
    wide_rest = placed.join(led, "doc", "left_anti").filter("parts > 1").groupBy("lead").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("shares"))
    rest = F.struct(F.col("lead").alias("group"), (F.lit(1 << 20) + F.pmod(F.xxhash64("doc"), F.coalesce("shares", F.lit(1)))).cast("long").alias("part"), F.col("doc").alias("known"))
    whole = F.struct("group", F.lit(0).cast("long").alias("part"), F.col("doc").alias("known"))
    joint = F.struct(F.col("known").alias("group"), (F.lit(1 << 21) + F.pmod(F.xxhash64("doc"), "cuts")).cast("long").alias("part"), "known")
    placed = placed.join(led, "doc", "left").join(wide_rest, "lead", "left")
    placed = placed.select("doc", F.when(F.col("parts") == 1, whole).when(F.col("known").isNotNull(), joint).otherwise(rest).alias("c")).select("doc", "c.*")
    placed = shared.stored(placed, "cells-placed")
    asked = contested(rows.select("token", "n", "doc", "pos").join(placed, "doc"))
    asked = shared.stored(asked.join(placed.select("doc", "known"), "doc").select("group", "part", F.lit(1).alias("role"), "doc", "known"), "asked")
    apart = placed.groupBy("group", "part").agg((F.min("known") != F.max("known")).alias("apart"))
    busy = apart.filter("apart").select("group", "part").unionByName(asked.select("group", "part")).distinct()
    members = placed.join(busy, ["group", "part"], "left_semi").select("group", "part", F.lit(0).alias("role"), "doc", "known")
    cells = shared.stored(screened(members.unionByName(asked), rows), "cells")
    links = star.unionByName(joined).unionByName(open_groups(reps, cells.filter("role = 0"), cells.filter("role = 1")))
    final = components(links)

    lead = shared.join_groups(member.select("doc", "n", "rep"), member.groupBy("rep").agg(F.count("*").alias("copies")).join(final, F.col("rep") == F.col("node"), "left").select("rep", "copies", F.coalesce("component", "rep").alias("component")), ["rep"], "copies")
    alone = sized.filter("n = 0 OR doc IS NULL").select("doc", "n", F.col("doc").alias("component"))
    return lead.select("doc", "n", "component").unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the document with the smallest id of every component stays."""
    found = near_duplicates(docs)
    gone = shared.stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("drop_id")).distinct(), "near-copies")
    return shared.without_ids(docs, gone)
