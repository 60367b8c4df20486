"""A causal self-attention model over subword ids in numpy: scoring, and training with the gradients written out.

The model reads a window of ``SPAN`` pieces, each a vector of ``WIDTH`` numbers with a place
added, attends once, causally, passes a small feed-forward layer and predicts the next piece.
The softmax over the whole vocabulary is a binary tree whose leaves are the pieces: every node
splits by a sigmoid of the state, so that a probability takes about as many products as the
piece has bits. The root parts pieces that begin words from others; below, nodes are cut along
the direction in which the pieces differ most by what precedes them, halving the mass.
"""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN, SPAN, LAP = 16, 32, 32, 8
BATCH, RATE = 48, 0.04
#: Frequent pieces by whose company the others are described.
COMPANY = 128
F32 = np.float32
#: Logits are clipped here: a product over a way of up to 35 nodes then fits a double.
LIMIT = 20


class Tree:
    """Nodes and signs on the way to each piece, as flat arrays."""

    def __init__(self, counts: np.ndarray, initial: np.ndarray, near: np.ndarray):
        mass = counts + 1e-3
        share = mass / mass.sum()
        off = near - share @ near
        axes = np.linalg.eigh((off * share[:, None]).T @ off)[1][:, ::-1][:, :8]
        place = off @ axes
        nodes: list[list[int]] = [[] for _ in counts]
        signs: list[list[int]] = [[] for _ in counts]
        todo = [(np.flatnonzero(initial), np.flatnonzero(~initial))]
        self.n_nodes = 0
        while todo:
            sides = todo.pop()
            if not len(sides[0]) or not len(sides[1]):  # only at the root, if all pieces are of one kind
                sides = (whole := np.concatenate(sides))[:0], whole
            else:
                for side, sign in zip(sides, (1, -1), strict=True):
                    for piece in side.tolist():
                        nodes[piece].append(self.n_nodes)
                        signs[piece].append(sign)
                self.n_nodes += 1
            todo += [self._cut(side, mass, place) for side in sides if len(side) > 1]
        self.length = np.array([len(x) for x in nodes])
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([k for x in nodes for k in x], np.int32)
        self.sign = np.array([k for x in signs for k in x], F32)

    @staticmethod
    def _cut(side: np.ndarray, mass: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, x = mass[side] / mass[side].sum(), place[side]
        widest = (own @ (x - own @ x) ** 2).argmax()
        side = side[np.lexsort((-own, x[:, widest]))]
        total = np.cumsum(mass[side])
        at = int(np.abs(total[:-1] - total[-1] / 2).argmin()) + 1
        return side[:at], side[at:]

    def ways(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its number of nodes and where they begin in the nodes and signs of all."""
        length = self.length[pieces]
        first = np.cumsum(length) - length
        at = np.repeat(self.start[pieces] - first, length) + np.arange(int(length.sum()))
        return length, first, self.node[at], self.sign[at]


class Model:
    """Weights by name; ``end`` is the id that ends, and stands before, every document.

    counts: of every piece, the end last; initial: whether a piece begins a word (the end does);
    near: for every piece a row that describes what precedes it.
    """

    def __init__(self, counts: np.ndarray, initial: np.ndarray, near: np.ndarray, seed: int = 7):
        self.end, d = len(counts) - 1, WIDTH
        self.tree = Tree(counts, initial, near)
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(F32)
        n = self.tree.n_nodes
        # with no state, nodes split as the counts do
        length, _, node, sign = self.tree.ways(np.arange(len(counts)))
        mass = np.repeat(counts + 0.5, length)
        bias = np.log(np.bincount(node, mass * (sign > 0), n) / np.bincount(node, mass * (sign < 0), n)).astype(F32)
        self.weights = {
            "pieces": small(len(counts), d), "nodes": np.concatenate((small(n, d) * F32(0.1), bias[:, None]), axis=1),
            "places": small(SPAN, d), "query": small(d, d), "key": small(d, d), "value": small(d, d), "wide": small(d, HIDDEN), "lift": np.zeros(HIDDEN, F32), "narrow": small(HIDDEN, d),
        }

    def leaves(self, state: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """log P(piece | state) for each row. Rows of a frequent piece are taken together: their nodes are the same."""
        order = np.argsort(pieces, kind="stable")
        found, first, times = np.unique(pieces[order], return_index=True, return_counts=True)
        out = np.empty(len(pieces))
        often = times >= 16
        for piece, a, n in zip(found[often].tolist(), first[often].tolist(), times[often].tolist(), strict=True):
            own, way = order[a : a + n], slice(self.tree.start[piece], self.tree.start[piece] + self.tree.length[piece])
            nodes = self.weights["nodes"][self.tree.node[way]] * -self.tree.sign[way, None]
            z = nodes[:, :-1] @ state[own].T
            z += nodes[:, -1:]
            np.exp(np.clip(z, -LIMIT, LIMIT, out=z), out=z)
            z += 1
            whole = z[0].astype(np.float64)
            for row in z[1:]:
                whole *= row
            out[own] = -np.log(whole)
        rest = order[np.repeat(~often, times)]
        if len(rest):
            length, start, node, sign = self.tree.ways(pieces[rest])
            nodes = self.weights["nodes"][node]
            z = np.einsum("ij,ij->i", nodes[:, :-1], np.repeat(state[rest], length, axis=0)) + nodes[:, -1]
            out[rest] = -np.add.reduceat(np.log1p(np.exp(np.clip(-sign * z, -LIMIT, LIMIT))), start)
        return out

    def log10(self, ids: np.ndarray, sizes: np.ndarray, batch: int = 64, together: int = 160) -> np.ndarray:
        """For each document (its pieces, end included, among ``ids``) the log10 of its probability.

        Documents are cut into windows of ``SPAN`` pieces that overlap by ``LAP``, so that every
        piece is scored once, after at least ``LAP`` others if there are any. ``batch`` windows
        attend at a time: few, so that their arrays stay in a core's cache; the pieces of
        ``together`` such batches are then scored at once.
        """
        sizes, w, d = np.asarray(sizes, np.int64), self.weights, WIDTH
        stops = np.cumsum(sizes)
        begins = stops - sizes
        known = np.empty(len(ids), np.int64)  # what is read: the end id, then all but the last piece
        known[1:] = ids[:-1]
        known[begins] = self.end
        step = SPAN - LAP
        count = 1 + np.maximum(0, -(-(sizes - SPAN) // step))
        doc = np.repeat(np.arange(len(sizes)), count)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = begins[doc] + turn * step
        out = np.zeros(len(sizes))
        held: list[tuple[np.ndarray, ...]] = []  # states whose pieces are to be scored together
        mask = np.tril(np.ones((SPAN, SPAN), F32))
        one = np.ones((batch, SPAN, 1), F32)
        heads = np.concatenate((w["query"] / F32(np.sqrt(d)), w["key"], w["value"]), axis=1)
        for a in range(0, len(doc), batch):
            at = start[a : a + batch, None] + np.arange(SPAN)
            inside = at < stops[doc[a : a + batch], None]
            fresh = inside & ((turn[a : a + batch, None] == 0) | (np.arange(SPAN) >= LAP))
            at = np.minimum(at, len(ids) - 1)
            x = w["pieces"][known[at]] + w["places"]
            qkv = (x.reshape(-1, d) @ heads).reshape(-1, SPAN, 3 * d)
            s = qkv[:, :, :d] @ qkv[:, :, d : 2 * d].transpose(0, 2, 1)
            np.exp(np.minimum(s, 30, out=s), out=s)
            s *= mask
            o = s @ np.concatenate((qkv[:, :, 2 * d :], one[: len(x)]), axis=2)
            h = (x + o[:, :, :d] / o[:, :, d:])[fresh]
            h += np.maximum(h @ w["wide"] + w["lift"], 0) @ w["narrow"]
            held.append((np.repeat(doc[a : a + batch], fresh.sum(axis=1)), h, ids[at[fresh]]))
            if a + batch >= len(doc) or len(held) >= together:
                of, states, wanted = map(np.concatenate, zip(*held, strict=True))
                out += np.bincount(of, self.leaves(states, wanted), len(sizes))
                held.clear()
        return out / np.log(10)


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index once, with the sum of its rows."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Adam on windows, starting from a model's weights (a copy); ``used`` counts the steps that touched each row."""

    SPARSE = ("pieces", "nodes")

    def __init__(self, model: Model):
        self.tree, self.end = model.tree, model.end
        self.w = {k: v.copy() for k, v in model.weights.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.used = {k: np.zeros(len(self.w[k]), np.int64) for k in self.SPARSE}
        self.steps = 0
        self.mask = np.tril(np.ones((SPAN, SPAN), F32))

    def learn(self, ids: np.ndarray, rng: np.random.Generator, progress: float) -> None:
        """Once over ``ids`` (documents, each after an end), in windows from a random start, in random order."""
        ids = np.concatenate((np.asarray(ids, np.int64), np.full(SPAN + 1, self.end)))
        shift = int(rng.integers(0, SPAN))
        start = rng.permutation(np.arange(shift if len(ids) > 2 * SPAN + 1 else 0, len(ids) - SPAN, SPAN))
        for a in range(0, len(start), BATCH):
            self._step(ids[start[a : a + BATCH, None] + np.arange(SPAN + 1)], progress)

    def _step(self, ids: np.ndarray, progress: float) -> None:
        w, flat = self.w, lambda m: m.reshape(-1, m.shape[-1])
        read, wanted = ids[:, :-1], ids[:, 1:].reshape(-1)
        scale, share = F32(1 / np.sqrt(WIDTH)), F32(1 / len(wanted))
        # forward
        x = w["pieces"][read] + w["places"]
        q, k, v = x @ w["query"], x @ w["key"], x @ w["value"]
        s = np.exp(np.minimum(q @ k.transpose(0, 2, 1) * scale, 30)) * self.mask
        a = s / s.sum(axis=2, keepdims=True)
        h = flat(x + a @ v)
        z = h @ w["wide"] + w["lift"]
        r = np.maximum(z, 0)
        state = h + r @ w["narrow"]
        length, first, node, sign = self.tree.ways(wanted)
        nodes = w["nodes"][node]
        states = np.concatenate((np.repeat(state, length, axis=0), np.ones((len(node), 1), F32)), axis=1)
        miss = -sign / (1 + np.exp(np.clip(sign * np.einsum("ij,ij->i", nodes, states), -LIMIT, LIMIT))) * share
        # backward
        grad = {}
        d_state = np.add.reduceat(miss[:, None] * nodes[:, :-1], first, axis=0)
        grad["narrow"] = r.T @ d_state
        d_r = (d_state @ w["narrow"].T) * (z > 0)
        grad["wide"], grad["lift"] = h.T @ d_r, d_r.sum(axis=0)
        d_h = (d_state + d_r @ w["wide"].T).reshape(x.shape)
        d_a, d_v = d_h @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ d_h
        d_s = a * (d_a - (d_a * a).sum(axis=2, keepdims=True)) * scale
        d_q, d_k = d_s @ k, d_s.transpose(0, 2, 1) @ q
        d_x = d_h + d_q @ w["query"].T + d_k @ w["key"].T + d_v @ w["value"].T
        grad |= {"query": flat(x).T @ flat(d_q), "key": flat(x).T @ flat(d_k), "value": flat(x).T @ flat(d_v), "places": d_x.sum(axis=0)}
        # Adam; of the large tables only the rows that were touched
        self.steps += 1
        rate = F32(RATE * (min(1.0, progress * 20 + 0.02 * self.steps) * (1 - progress) + 0.025))
        fix = F32(np.sqrt(1 - 0.98**self.steps) / (1 - 0.9**self.steps))
        every = slice(None)
        sparse = {"pieces": _summed(read.reshape(-1), flat(d_x)), "nodes": _summed(node, miss[:, None] * states)}
        for name, (rows, g) in {**{n: (every, g) for n, g in grad.items()}, **sparse}.items():
            m, v2 = self.moments[name]
            m[rows] += F32(0.1) * (g - m[rows])
            v2[rows] += F32(0.02) * (g * g - v2[rows])
            w[name][rows] -= rate * fix * m[rows] / (np.sqrt(v2[rows]) + F32(1e-8))
        for name, (rows, _) in sparse.items():
            self.used[name][rows] += 1

    def changes(self, model: Model, block: int = 4096) -> list[tuple[str, bytes]]:
        """What was learned, to be added up over trainers (``add``): for every block with changes its name and rows."""
        out = []
        for name, now in self.w.items():
            flat = now.reshape(len(now), -1) if name in self.SPARSE else now.reshape(1, -1)
            used = self.used[name] if name in self.SPARSE else np.array([self.steps])
            rows = np.flatnonzero(used)
            moved = (flat[rows] - model.weights[name].reshape(flat.shape)[rows]) * used[rows, None].astype(F32)
            for k in np.unique(rows // block).tolist():
                own = rows // block == k
                out.append((f"{name}:{k}", _packed(rows[own], np.concatenate((used[rows[own], None].astype(F32), moved[own]), axis=1))))
        return out


def _packed(rows: np.ndarray, values: np.ndarray) -> bytes:
    """Row numbers, then for each row its use and its change weighted by that."""
    return len(rows).to_bytes(4, "little") + rows.astype("<u4").tobytes() + values.astype("<f4").tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:4], "little")
    return np.frombuffer(payload, "<u4", n, 4).astype(np.int64), np.frombuffer(payload, "<f4", offset=4 + 4 * n).reshape(n, -1)


def add(payloads: list[bytes]) -> bytes:
    """The sum of changes of one block, added one after another."""
    rows = np.unique(np.concatenate([_unpacked(x)[0] for x in payloads]))
    total = np.zeros((len(rows), _unpacked(payloads[0])[1].shape[1]), F32)
    for own, values in map(_unpacked, payloads):
        total[np.searchsorted(rows, own)] += values
    return _packed(rows, total)


def apply(model: Model, sums: list[tuple[str, bytes]]) -> None:
    """Move every weight by the mean of its changes, weighted by use."""
    for key, payload in sums:
        w = model.weights[key.split(":")[0]]
        flat = w.reshape(len(w), -1) if key.split(":")[0] in Trainer.SPARSE else w.reshape(1, -1)
        rows, values = _unpacked(payload)
        flat[rows] += values[:, 1:] / np.maximum(values[:, :1], 1)
