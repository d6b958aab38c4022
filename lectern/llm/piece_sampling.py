"""SentencePiece encoding with sampled segmentations, without replacement, and decoding.

The vocabulary is a given SentencePiece model file (never trained here); its pieces get unigram
log-probabilities by rank, log(1 / (rank + OFFSET)) normalised.  A text's segmentations are the paths
of its lattice.  `samples` distinct ones are drawn by Gumbel top-k: every path has the key
log-probability + Gumbel noise, and the paths with the largest keys come out in order.  The search
is A*: the queue holds regions of the lattice, each with the exact largest key inside it, which is known
without opening it, for backward sums give the mass of every node, and the largest of many Gumbels
is a Gumbel at their log-sum, truncated at the key of the region it was cut from.  A popped region gives
its best path, by draws in proportion to mass, and falls apart into what leaves the old path before
that place, at it and after it, and what leaves the new path later.  Nothing is truncated beyond the
rounding of doubles.

No piece spans a blank or a line break inside, so a lattice is a chain of chunk lattices; each
slice of texts builds those of its distinct chunks once, and draws for all texts advance together.
All randomness is a hash of (seed, row key, sample, place), so results do not depend on partitions.

With the (k+1)-th key c, log_inclusion is log(1 - exp(-exp(log_prob - c))): the chance that a
segmentation is among the k, for inverse-probability weights.  Texts with fewer than k
segmentations return them all with chance 1.

Cases: null counts as empty: one segmentation, no pieces.  Characters outside the vocabulary become
byte pieces; a literal U+2581 does too, so decoding returns every text exactly.  Long texts are steps of
their own.  Rows that repeat (same id, same text) get the same segmentations; null ids share one row
key.  Ties cannot decide anything: equal probabilities still have different noise.  An empty table
gives an empty table.  Other columns, also ones named like the results, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_keys, mix, powers, steps, uniform

U = np.uint64
OFFSET = 10.0
UNKNOWN = 10.0
BLANK, LITERAL = "▁", "\ud800"
STEP = 1 << 18
#: Ids that one vectorised decoding step looks at.
IDS = 1 << 18
#: Below this log loss along a path, what leaves it is summed edge by edge instead of by difference.
THIN = 1e-6
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary as arrays: hashes, ids, log-probabilities, prefixes and bytes of the pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        logs = {i: -np.log(rank[i] + OFFSET) for i in plain}
        total = np.log(sum(np.exp(x) for x in logs.values()))
        words = {i: model.id_to_piece(i) for i in plain}
        hashes, prefixes = [], set()
        for i in plain:
            h = 0
            for c in words[i]:
                h = (h * int(_P) + ord(c) + 1) % (1 << 64)
                prefixes.add(h)
            hashes.append(h)
        self.hash, self.id = np.array(hashes, U), np.array(plain, np.int64)
        self.log = np.array([logs[i] - total for i in plain])
        self.lost = float(self.log.min() - UNKNOWN)
        self.longest = max(map(len, words.values()))
        self.prefix = np.zeros(1 << 20, bool)
        self.prefix[(np.array(sorted(prefixes), U) * _Q >> U(44)).astype(np.int64)] = True
        # piece numbers by hash cell; a piece whose cell is taken is found by another cell
        cells = self.hash * _Q
        first, other = (cells >> U(44)).astype(np.int64), (cells >> U(22) & U((1 << 20) - 1)).astype(np.int64)
        self.table, self.spare = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
        self.table[first[::-1]] = np.arange(len(plain), dtype=np.int32)[::-1]
        moved = np.flatnonzero(self.table[first] != np.arange(len(plain)))
        self.spare[other[moved]] = moved
        if (self.find(self.hash, cells) != np.arange(len(plain))).any():
            raise ValueError("two pieces of the vocabulary share both hash cells")
        raw = [b""] * n
        for i, w in words.items():
            raw[i] = w.replace(BLANK, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.words = pa.array(raw, pa.binary())

    def find(self, h: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Piece number of each hash (cells: times _Q), or -1."""
        i = self.table[(cells >> U(44)).astype(np.int64)]
        lost = np.flatnonzero(self.hash[i] != h)
        i[lost] = self.spare[(cells[lost] >> U(22) & U((1 << 20) - 1)).astype(np.int64)]
        lost = lost[self.hash[i[lost]] != h[lost]]
        i[lost] = -1
        return i


class Lattice:
    """The lattices of distinct chunks.  Nodes are numbered chunk by chunk, each with one end node."""

    def __init__(self, pieces: Pieces, chars: np.ndarray, sizes: np.ndarray):
        chunks = len(sizes)
        begin = np.cumsum(sizes) - sizes
        self.first = begin + np.arange(chunks)
        place = np.arange(len(chars))
        chunk = np.repeat(np.arange(chunks), sizes)
        left = (begin + sizes)[chunk] - place
        node = place + chunk
        found, live, h = [], place, np.zeros(len(chars), U)
        single = np.zeros(len(chars), bool)
        for n in range(1, pieces.longest + 1):
            fits = left[live] >= n
            live, h = live[fits], h[fits]
            h = h * _P + chars[live + n - 1].astype(U) + U(1)
            cell = h * _Q
            some = pieces.prefix[(cell >> U(44)).astype(np.int64)]
            live, h, cell = live[some], h[some], cell[some]
            if not len(live):
                break
            i = pieces.find(h, cell)
            hit = i >= 0
            found.append((live[hit], n, pieces.id[i[hit]], pieces.log[i[hit]]))
            if n == 1:
                single[live[hit]] = True
        bare = place[~single]
        found.append((bare, 1, -chars[bare].astype(np.int64) - 1, np.full(len(bare), pieces.lost)))
        # edges by start node, longest first: the likely edges of a node come first
        many = np.zeros(len(chars), np.int64)
        for live_, *_ in found:
            many[live_] += 1
        first = np.cumsum(many) - many
        free, total = first.copy(), int(many.sum())
        start, target, piece, log = np.repeat(place, many), np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for live_, n, i, x in found[::-1]:
            at = free[live_]
            free[live_] += 1
            target[at], piece[at], log[at] = node[live_] + n, i, x
        mass = np.zeros(len(chars) + chunks)
        away = np.argsort(left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left, kind="stable")
        cuts = np.searchsorted(left[away], np.arange(1, (left[away[-1]] if len(away) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            s = away[a:b]
            n = many[s]
            g = np.cumsum(n) - n
            e = np.arange(int(n.sum())) + np.repeat(first[s] - g, n)
            value = log[e] + mass[target[e]]
            top = np.maximum.reduceat(value, g)
            mass[node[s]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), g))
        self.begin, self.end, self.piece = node[start], target, piece
        self.share = np.minimum(log + mass[self.end] - mass[self.begin], 0.0)
        total = np.cumsum(np.exp(self.share))
        base = np.concatenate(([0.0], total))[first]
        self.within = total - np.repeat(base, many)
        self.within[first + many - 1] = 2.0
        self.group = np.full(len(mass), len(start))
        self.group[node] = first
        self.count = np.zeros(len(mass), np.int64)
        self.count[node] = many

    def draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, number for each start): from each start node to its chunk's end, by mass."""
        at, who, turn, took = nodes, np.arange(len(nodes)), 0, []
        while True:
            many = self.count[at]
            busy = np.flatnonzero(many)
            if not len(busy):
                break
            if len(busy) < len(at):
                at, who, many = at[busy], who[busy], many[busy]
            e = self.group[at]
            walk = np.flatnonzero(many > 1)
            u, near = uniform(turn, seed=keys[who[walk]]), e[walk]
            go = np.flatnonzero(u > self.within[near])
            while len(go):
                near[go] += 1
                go = go[u[go] > self.within[near[go]]]
            e[walk] = near
            took.append((who, e))
            at, turn = self.end[e], turn + 1
        count = np.bincount(np.concatenate([w for w, _ in took]), minlength=len(nodes)) if took else np.zeros(len(nodes), np.int64)
        edges, base = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        for t, (w, e) in enumerate(took):
            edges[base[w] + t] = e
        return edges, count


def _gumbel(mean, top, u):
    """A Gumbel at `mean`, given that it does not exceed `top`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(mean), -np.inf, mean - np.log(np.exp(mean - top) - np.log(u)))


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Drawn:
    """The paths drawn so far, one after the other: edges, their chunks, log mass left after each edge."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.edge, self.link, self.after = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, heads: np.ndarray, head: np.ndarray, edge: np.ndarray, tail: np.ndarray, tail_link: np.ndarray, tails: np.ndarray):
        """Paths from the first `head` places of the paths at `heads`, then `edge` (-1: none), then tails."""
        size = head + (edge >= 0) + tails
        begin = len(self.edge) + np.cumsum(size) - size
        edges, links, after = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()))
        own = begin - len(self.edge)
        old, new = np.repeat(heads, head) + _inner(head), np.repeat(own, head) + _inner(head)
        edges[new], links[new] = self.edge[old], self.link[old]
        some = np.flatnonzero(edge >= 0)
        edges[own[some] + head[some]], links[own[some] + head[some]] = edge[some], self.link[heads[some] + head[some]]
        new = np.repeat(own + size - tails, tails) + _inner(tails)
        edges[new], links[new] = tail, tail_link
        share = self.lattice.share[edges]
        for i, j in zip(own.tolist(), (own + size).tolist()):
            np.cumsum(share[i:j], out=after[i:j])
        self.edge, self.link, self.after = np.concatenate((self.edge, edges)), np.concatenate((self.link, links)), np.concatenate((self.after, after))
        return begin, size

    def before(self, begin, place):
        """Log mass of the segmentations that share the first `place` edges of the path at `begin`."""
        return np.where(place > 0, self.after[np.maximum(begin + place - 1, 0)], 0.0)

    def leaving(self, begin: int, a: int, b: int) -> np.ndarray:
        """Log mass of what leaves the path at each of the places a to b - 1, summed edge by edge."""
        lattice, edge = self.lattice, self.edge[begin + a:begin + b]
        node = lattice.begin[edge]
        many = lattice.count[node]
        each = np.repeat(lattice.group[node], many) + _inner(many)
        mass = np.where(each != np.repeat(edge, many), np.exp(lattice.share[each]), 0.0)
        with np.errstate(divide="ignore"):
            return self.before(begin, np.arange(a, b)) + np.log(np.add.reduceat(mass, np.cumsum(many) - many))

    def mass(self, begin, a, b):
        """Log mass of what leaves the path at `begin` at any of the places a to b - 1."""
        low = self.before(begin, a)
        lost = self.before(begin, np.maximum(a, b)) - low
        with np.errstate(divide="ignore"):
            out = np.where(b > a, low + np.log(-np.expm1(np.minimum(lost, 0.0))), -np.inf)
        for i in np.flatnonzero((lost > -THIN) & (b > a)):
            each = self.leaving(int(begin[i]), int(a[i]), int(b[i]))
            top = each.max()
            out[i] = top if np.isneginf(top) else top + np.log(np.exp(each - top).sum())
        return out

    def place(self, begin, a, b, u):
        """The place where a segmentation of [a, b) leaves its path, by mass."""
        low = self.before(begin, a)
        lost = np.minimum(self.before(begin, b) - low, 0.0)
        want = -np.log1p(u * np.expm1(lost))
        at, end = a.copy(), b - 1
        while (at < end).any():
            half = (at + end) // 2
            here = low - self.after[begin + half] > want
            end, at = np.where(here, half, end), np.where(here | (at >= end), at, half + 1)
        while (back := (self.lattice.count[self.lattice.begin[self.edge[begin + at]]] < 2) & (at > a)).any():
            at = at - back
        for i in np.flatnonzero(lost > -THIN):
            each = self.leaving(int(begin[i]), int(a[i]), int(b[i]))
            share = np.cumsum(np.exp(each - each.max()))
            at[i] = a[i] + int(np.searchsorted(share, u[i] * share[-1], "right"))
        return at

    def side(self, begin, place, gone, u):
        """(edge, log mass of the others): by mass, one of the edges at a place that are not in `gone`."""
        lattice, node = self.lattice, self.lattice.begin[self.edge[begin + place]]
        many = lattice.count[node]
        cut = np.cumsum(many) - many
        each = np.repeat(lattice.group[node], many) + _inner(many)
        kept = np.ones(len(each), bool)
        for column in gone.T:
            kept &= each != np.repeat(column, many)
        mass = np.where(kept, np.exp(lattice.share[each]), 0.0)
        total = np.add.reduceat(mass, cut)
        sums = np.cumsum(mass / np.repeat(total, many))
        pick = np.searchsorted(sums, np.concatenate(([0.0], sums))[cut] + u, "right")
        pick = np.clip(pick, np.minimum.reduceat(np.where(kept, np.arange(len(each)), len(each)), cut), np.maximum.reduceat(np.where(kept, np.arange(len(each)), -1), cut))
        mass[pick] = 0.0
        with np.errstate(divide="ignore"):
            return each[pick], self.before(begin, place) + np.log(np.add.reduceat(mass, cut))


class Common:
    """The lattice of chunks that the first texts of a task repeat, kept for all later ones."""

    def __init__(self):
        self.names, self.lattice = np.empty(0, U), None
        self.room: dict[str, np.ndarray] = {}

    def followed_by(self, new: Lattice) -> Lattice:
        """Both in one, the new one's nodes and edges numbered after these; `first` stays unset.

        The arrays are views of room that the next call writes over.
        """
        out, old = object.__new__(Lattice), self.lattice
        for name in ("begin", "end", "group", "piece", "share", "within", "count"):
            a, b = getattr(old, name), getattr(new, name)
            room = self.room.get(name)
            if room is None or len(room) < len(a) + len(b):
                room = self.room[name] = np.empty(len(a) + 2 * len(b), a.dtype)
                room[:len(a)] = a
            shift = len(old.count) if name in ("begin", "end") else len(old.piece) if name == "group" else 0
            np.add(b, shift, out=room[len(a):len(a) + len(b)])
            setattr(out, name, room[:len(a) + len(b)])
        return out


def _chains(pieces: Pieces, texts: list[str], common: Common | None = None, learn: bool = False):
    """(chunk numbers of all texts in a row, chunks of each text, lattice of the distinct chunks).

    A chunk begins at a text's begin, at and after a line break, and where blanks follow something
    else; chunks are told apart by 64-bit hashes.
    """
    chars = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars == ord(BLANK), ord(LITERAL), np.where(chars == 32, ord(BLANK), chars)).astype(np.uint32)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts])))
    n = len(chars)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64), None
    blank, line = chars == ord(BLANK), chars == 10
    begins = line.copy()
    begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    begins[edges[:-1][edges[:-1] < edges[1:]]] = True
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], n)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(chars.astype(U)) * up[:n], out=sums[1:])
    names = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U))
    each, first, chain, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)

    def built(which):
        size = (stops - starts)[first[which]]
        place = np.arange(int(size.sum())) + np.repeat(starts[first[which]] - (np.cumsum(size) - size), size)
        return Lattice(pieces, chars[place], size)
    links = np.diff(np.searchsorted(starts, edges))
    if common is None:
        return chain, links, built(np.arange(len(each)))
    if common.lattice is None:
        often = np.flatnonzero(times > 1) if (times > 1).any() else np.arange(len(each))
        common.names, common.lattice = each[often], built(often)
        if learn:
            return None
    i = np.minimum(np.searchsorted(common.names, each), len(common.names) - 1)
    known = common.names[i] == each
    fresh = np.flatnonzero(~known)
    lattice, head = common.lattice, common.lattice.first[i]
    new = built(fresh)
    lattice = common.followed_by(new)
    head[fresh] = new.first + len(common.lattice.count)
    lattice.first = head
    return chain, links, lattice


def draw_samples(pieces: Pieces, texts: list[str], rows: np.ndarray, samples: int, seed: int, common: Common | None = None):
    """Up to `samples` segmentations of each text, best key first, texts in order.

    (text number, sample, log_prob, key, log_inclusion) as arrays, then the ids of all in a row and how
    many each has.
    """
    chain, links, lattice = _chains(pieces, texts, common)
    if not len(chain):
        n = np.zeros(len(texts), np.int64)
        return np.arange(len(texts)), n, *(np.zeros((3, len(texts)))), n[:0].astype(np.int32), n
    drawn, stop, base = Drawn(lattice), np.cumsum(links), np.cumsum(links) - links
    row_keys = fold_keys(U(seed), rows)
    link_keys = fold_keys(np.repeat(row_keys, links), np.arange(len(chain)) - np.repeat(base, links))
    noise = fold_keys(row_keys, 77)
    who = np.flatnonzero(links)
    none, zero = np.full(len(who), -1, np.int64), np.zeros(len(who), np.int64)
    head_at, head, edge, first, key = zero, zero, none, base[who], _gumbel(0.0, np.inf, uniform(0, 0, seed=noise[who]))
    # regions: what leaves the path at `path` at places a to b - 1, or at a alone by an edge not in `gone`
    regions = {name: np.empty(0, np.int64) for name in ("who", "path", "a", "b")} | {"gone": np.empty((0, samples + 1), np.int64), "key": np.empty(0)}
    out = []

    def push(kind, sample, who, path, a, b, gone, mass, top):
        new = {"who": who, "path": path, "a": a, "b": b, "gone": gone, "key": _gumbel(mass, top, uniform(sample, kind, seed=noise[who]))}
        some = new["key"] > -np.inf
        for name, column in new.items():
            regions[name] = np.concatenate((regions[name], column[some]))

    for sample in range(samples):
        # all texts advance together: the rest of the chunk that the edge is in, then all later chunks
        number = stop[who] - first
        link = np.repeat(first, number) + _inner(number)
        nodes, at = lattice.first[chain[link]], np.cumsum(number) - number
        turned = edge >= 0
        nodes[at[turned]] = lattice.end[edge[turned]]
        tail, count = lattice.draw(nodes, fold_keys(link_keys[link], sample))
        path, size = drawn.add(head_at, head, edge, tail, np.repeat(link, count), np.add.reduceat(count, at))
        out.append((who, np.full(len(who), sample), path, size, drawn.before(path, size), key))
        begin, fresh = head + turned, np.full((len(who), samples + 1), -1, np.int64)
        push(1, sample, who, path, begin, size, fresh, drawn.mass(path, begin, size), key)
        best = np.lexsort((-regions["key"], regions["who"]))
        best = best[np.concatenate(([True], np.diff(regions["who"][best]) > 0))] if len(best) else best
        if sample + 1 == samples or not len(best):
            break
        who, parent, a, b, gone, key = (regions[x][best] for x in ("who", "path", "a", "b", "gone", "key"))
        for name in regions:
            regions[name] = np.delete(regions[name], best, 0)
        span = gone[:, 0] < 0
        u, v = uniform(sample, 2, seed=noise[who]), uniform(sample, 3, seed=noise[who])
        place = a.copy()
        place[span] = drawn.place(parent[span], a[span], b[span], u[span])
        gone[span, 0] = drawn.edge[parent[span] + place[span]]
        edge, others = drawn.side(parent, place, gone, v)
        gone[np.arange(len(who)), (gone >= 0).sum(1)] = edge
        push(4, sample, who, parent, place, place + 1, gone, others, key)
        w, p, x, y, z, k = (column[span] for column in (who, parent, a, place, b, key))
        blank = np.full((len(w), samples + 1), -1, np.int64)
        push(5, sample, w, p, x, y, blank, drawn.mass(p, x, y), k)
        push(6, sample, w, p, y + 1, z, blank, drawn.mass(p, y + 1, z), k)
        head_at, head, first = parent, place, drawn.link[parent + place]
    who, sample, path, size, relative, key = (np.concatenate(x) for x in zip(*out))
    rest = np.full(len(texts), -np.inf)
    np.maximum.at(rest, regions["who"], regions["key"])
    # the (k+1)-th key is a threshold only where there are k segmentations
    rest[np.bincount(who, minlength=len(texts)) < samples] = -np.inf
    with np.errstate(divide="ignore", over="ignore"):
        lift = relative - rest[who]
        inclusion = np.where(lift > 30, 0.0, np.where(lift < -30, lift, np.log(-np.expm1(-np.exp(np.minimum(lift, 31.0))))))
    bare = np.flatnonzero(links == 0)
    none = np.zeros(len(bare), np.int64)
    who, sample, path, size = (np.concatenate(x) for x in ((who, bare), (sample, none), (path, none), (size, none)))
    relative, key, inclusion = (np.concatenate((x, np.zeros(len(bare)))) for x in (relative, key, inclusion))
    order = np.lexsort((sample, who))
    path, size = path[order], size[order]
    ids, many = _ids(pieces, lattice.piece[drawn.edge[np.repeat(path, size) + _inner(size)]])
    ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(size)))]
    return who[order], sample[order], relative[order], key[order], inclusion[order], ids, np.diff(ends)


def sample_texts(pieces: Pieces, texts: list[str], rows: np.ndarray, samples: int, seed: int, common: Common | None = None):
    """For each text up to `samples` of (ids, log_prob, key, log_inclusion), best key first."""
    who, _, log, key, inclusion, ids, size = draw_samples(pieces, texts, rows, samples, seed, common)
    out: list[list] = [[] for _ in texts]
    for d, part, *rest in zip(who.tolist(), np.split(ids, np.cumsum(size)[:-1]), log.tolist(), key.tolist(), inclusion.tolist()):
        out[d].append((part, *rest))
    return out


def _ids(pieces: Pieces, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many for each piece): an unknown character becomes the ids of its UTF-8 bytes."""
    many, odd = np.ones(len(piece), np.int64), np.flatnonzero(piece < 0)
    if not len(odd):
        return piece.astype(np.int32), many
    code = -piece[odd] - 1
    code = np.where(code == ord(LITERAL), ord(BLANK), code)
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    many[odd] = size
    turn, c, n = _inner(size), np.repeat(code, size), np.repeat(size, size)
    later = 0x80 | (c >> np.maximum(6 * (n - 1 - turn), 0)) & 0x3F
    lead = np.where(n == 1, c, (0xF00 >> n) & 0xFF | c >> np.maximum(6 * (n - 1), 0))
    ids = np.repeat(piece, many).astype(np.int32)
    ids[np.repeat((np.cumsum(many) - many)[odd], size) + turn] = pieces.byte_ids[np.where(turn == 0, lead, later) & 0xFF]
    return ids, many


def _map_encode(shared, samples: int, seed: int):
    def run(batches):
        pieces, common = shared.value, Common()
        for batch in batches:
            if common.lattice is None:
                first = next(steps(batch, limit=8 * STEP), None)
                _chains(pieces, [t or "" for t in first.column("text").to_pylist()] if first is not None else [], common, learn=True)
            for part in steps(batch, limit=STEP):
                rows = part.column("row_key").to_numpy(zero_copy_only=False)
                who, sample, *scores, flat, size = draw_samples(pieces, [t or "" for t in part.column("text").to_pylist()], rows, samples, seed, common)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))
                other = part.drop_columns(["text", "row_key"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*other.columns, pa.array(sample.astype(np.int32)), ids, *map(pa.array, scores)],
                                                 names=[*other.schema.names, "sample", "ids", "log_prob", "key", "log_inclusion"])
    return run


def _decode(pieces: Pieces, lists: pa.ListArray) -> pa.StringArray:
    """The text of each list of ids, without the blank put before a text."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.words.take(lists.flatten())), b"")
    _, ends, raw = joined.buffers()
    ends = np.frombuffer(ends, np.int32, len(joined) + 1, joined.offset * 4)
    raw = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.empty(0, np.uint8)
    keep, some = np.ones(len(raw), bool), np.diff(ends) > 0
    keep[(ends[:-1] - ends[0])[some]] = False
    ends = np.concatenate(([0], np.cumsum(np.diff(ends) - some))).astype(np.int32)
    return pa.StringArray.from_buffers(len(joined), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[keep].tobytes()))


def _map_decode(shared, drop: bool):
    def run(batches):
        pieces = shared.value
        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(IDS, ends[-1] if len(ends) else 0, IDS)) + 1, [len(ends)])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                rest = part.drop_columns(["ids"]) if drop else part
                yield pa.RecordBatch.from_arrays([*rest.columns, _decode(pieces, part.column("ids"))], names=[*rest.schema.names, "decoded"])
    return run


def _ddl(df: DataFrame, gone: tuple, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in gone), *more])


def encode(docs: DataFrame, vocabulary: str, samples: int = 3, seed: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_crc32, sample, ids, log_prob, key, log_inclusion).

    log_prob is the segmentation's share of all segmentations of the text; a row for each sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(vocabulary))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("row_key"))
    return rows.mapInArrow(_map_encode(shared, samples, seed), _ddl(rows, ("text", "row_key"), "sample int", "ids array<int>", "log_prob double", "key double", "log_inclusion double"))


def decode(encoded: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """encoded(ids, ...) with the text of its pieces as `decoded`."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(vocabulary))
    return encoded.mapInArrow(_map_decode(shared, not keep_ids), _ddl(encoded, () if keep_ids else ("ids",), "decoded string"))
