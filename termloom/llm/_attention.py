"""A small causal self-attention language model in numpy: forward pass, gradients, training.

Texts are sequences of symbols (subword ids; the rarest share a symbol). A sequence is cut into blocks. The
positions of a block attend to themselves, to those before them in the block and to the block before, all
blocks of a batch at once under one mask: windows of two blocks that overlap by one, of which each position
is scored in the later block.
"""

from __future__ import annotations

import math

import numpy as np

#: Positions of a block: half a window.
BLOCK = 32
FAR = -1e9


def _units(dtype: np.dtype) -> tuple[float, float]:
    """What scores are multiplied by, and what is added, before they are :func:`raised`: in single precision powers of
    two in the places that the bits of a number have for them."""
    return (12102203.16, 1064866805.0) if dtype == np.float32 else (1.0, 0.0)


def raised(z: np.ndarray) -> np.ndarray:
    """The model's positive function of its scores (in :func:`_units`, one block of memory), in place: e to the score
    with straight lines between the powers of two (single precision), written into the bits of the numbers. Wider
    precision has the exponential. Scores beyond 80 either way count as 80."""
    scale, more = _units(z.dtype)
    np.clip(z, z.dtype.type(more - 80 * scale), z.dtype.type(more + 80 * scale), out=z)
    if z.dtype != np.float32:
        return np.exp(z, out=z)
    flat = z.reshape(-1)  # one dimension: numpy then converts in place, without a copy
    flat.view(np.int32)[...] = flat
    return z


class Symbols:
    """Subword ids as symbols in groups: a group is predicted first, then the symbol within it.

    Ids that begin a word and ids that go on with one are in different groups, so that the chance that a word
    ends is a sum over groups. The ``kinds`` most frequent ids are symbols of their own, in groups of ``members``
    of like frequency, and so is the end of a text, which begins no word but follows one. The rest of either
    sort is a group of one symbol; there an id has its share of the group's tokens in the training corpus (plus
    one for every id of the vocabulary), so that probabilities over all ids sum to one.
    """

    def __init__(self, counts: np.ndarray, begins: np.ndarray, ends: int, kinds: int = 1024, members: int = 32) -> None:
        self.members = members
        frequent = np.argsort(-counts, kind="stable")[:kinds]
        often = np.zeros(len(counts), bool)
        often[frequent] = True
        #: Symbol of each id (group * members + member), and the logarithm of its share in a group of the rest.
        self.of, self.within = np.zeros(len(counts), np.int32), np.zeros(len(counts))
        self.end = 0
        frequency, starts = [], []
        for first in (True, False):
            own = frequent[begins[frequent] == first]
            at = len(starts) * members
            self.of[own] = at + first + np.arange(len(own))
            weights = np.concatenate([np.full(int(first), ends), counts[own]])
            groups = -(-len(weights) // members)
            frequency.append(np.concatenate([weights, np.full(groups * members - len(weights), -1)]))
            starts += [first] * groups
            rest = ~often & (begins == first)
            if rest.any():
                self.of[rest] = len(starts) * members
                share = counts[rest].astype(np.float64) + 1
                self.within[rest] = np.log(share / share.sum())
                frequency.append(np.concatenate([[counts[rest].sum()], np.full(members - 1, -1)]))
                starts.append(first)
        #: Tokens of each place in the groups (-1: no symbol is there), and which groups begin words.
        self.frequency, self.begins = np.concatenate(frequency).astype(np.float64), np.array(starts)


class AttentionModel:
    """One layer of masked attention with a learned bias for each distance, and a feed-forward layer."""

    def __init__(self, params: dict[str, np.ndarray], symbols: Symbols) -> None:
        self.params, self.symbols = params, symbols
        self.width, self.groups = params["embed"].shape[1], len(symbols.begins)
        #: Distances of the keys (the block before, then the own block) from each position; what is later is masked.
        apart = (np.arange(BLOCK)[:, None] + BLOCK) - np.arange(2 * BLOCK)[None]
        self.seen, self.apart = apart >= 0, np.maximum(apart, 0)
        #: Groups of one symbol come last in the order of work: within them nothing is to be chosen.
        sizes = (symbols.frequency >= 0).reshape(self.groups, symbols.members).sum(1)
        self.turns = np.argsort(sizes <= 1, kind="stable")
        self.turn = np.argsort(self.turns).astype(np.uint8 if self.groups < 256 else np.int64)
        self.choices = int((sizes > 1).sum())
        self.spaces: dict[str, np.ndarray] = {}

    def _space(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        """Memory that batch after batch works in: fresh memory costs more than what is done in it."""
        size, found = math.prod(shape), self.spaces.get(name)
        if found is None or len(found) < size or found.dtype != dtype:
            found = self.spaces[name] = np.empty(size, dtype)
        return found[:size].reshape(shape)

    @classmethod
    def fresh(cls, symbols: Symbols, width: int = 16, hidden: int = 32, seed: int = 7) -> AttentionModel:
        """Small random weights; the output starts as the frequencies."""
        rng, n, groups, members = np.random.default_rng(seed), len(symbols.frequency), len(symbols.begins), symbols.members
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        weight = np.maximum(symbols.frequency + 1, 0).reshape(groups, members)
        whole = weight.sum(1, keepdims=True)
        return cls(
            {
                "embed": draw(n, width, scale=0.5), "bias": np.zeros(2 * BLOCK, np.float32), "qkv": draw(width, 3 * width, scale=width**-0.5), "mix": draw(width, width, scale=width**-0.5),
                "last": draw(width, width, scale=0.3 * width**-0.5), "up": draw(width, hidden, scale=(2 / width) ** 0.5), "up0": np.zeros(hidden, np.float32), "down": draw(hidden, width, scale=0.5 * hidden**-0.5), "down0": np.zeros(width, np.float32),
                "out": draw(width, groups, scale=0.02), "out0": np.log(whole[:, 0] / whole.sum()).astype(np.float32),
                "own": draw(groups, width, members, scale=0.02), "own0": np.where(weight > 0, np.log(np.maximum(weight, 1) / whole), FAR).astype(np.float32),
            },
            symbols,
        )

    def _told(self) -> np.ndarray:
        """Queries, keys, values and what the next position gets directly, for each symbol: nothing else tells them."""
        return self.params["embed"] @ self._weights(1, _units(self.params["embed"].dtype)[0])

    def _heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the groups' and of the members' scores in :func:`_units`, what is added to the scores last."""
        p, (scale, more) = self.params, _units(self.params["out"].dtype)
        kind = p["out"].dtype.type
        out, own = np.vstack([p["out"], p["out0"]]) * kind(scale), np.concatenate([p["own"], p["own0"][:, None]], 1) * kind(scale)
        out[-1] += kind(more)
        own[:, -1] += kind(more)
        return out, own

    def _inside(self, inputs: np.ndarray, fresh: np.ndarray, told: np.ndarray) -> dict[str, np.ndarray]:
        """States of blocks of input symbols, in order; ``fresh`` blocks have none before them. Weights of the keys
        (``a``) are not divided by their sums (``total``); ``k`` is in :func:`_units`, ``v`` is mixed already, ``y`` ends
        in a one, for what is added to the scores. They hold until the next call."""
        p, n, d = self.params, len(inputs), self.width
        flat = inputs.ravel()
        x = p["embed"].take(flat, 0)
        kind = x.dtype
        scale, more = _units(kind)
        # What the symbols tell, behind an empty block.
        every = self._space("every", ((n + 1) * BLOCK, 4 * d), kind)
        every[:BLOCK] = 0
        np.take(told, flat, 0, out=every[BLOCK:], mode="clip")
        q = every[BLOCK:, :d].reshape(n, BLOCK, d)
        step, size = every.strides
        k, v = (np.ndarray((n, 2 * BLOCK, d), kind, every, low * size, (BLOCK * step, step, size)) for low in (d, 2 * d))
        a = np.matmul(q, k.transpose(0, 2, 1), out=self._space("a", (n, BLOCK, 2 * BLOCK), kind))
        a += (p["bias"][self.apart] * scale + more).astype(kind)
        # Nothing at all where a position doesn't look: next to nothing would be too small for quick arithmetic later.
        raised(a)
        a *= self.seen.astype(kind)
        a[fresh, :, :BLOCK] = 0
        total = a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind)
        o = np.matmul(a, v).reshape(-1, d)
        o /= total[:, None]
        g = o + x
        # The symbol before the input, directly: nothing before a fresh block.
        first = np.flatnonzero(fresh) * BLOCK
        kept = g[first]
        g += every[BLOCK - 1 : -1, 3 * d :]
        g[first] = kept
        u = g @ p["up"]
        u += p["up0"]
        r = np.clip(u, 0, None, out=u)
        y = self._space("y", (n * BLOCK, d + 1), kind)
        y[:, d] = 1
        np.matmul(r, p["down"], out=y[:, :d])
        y[:, :d] += g + p["down0"]
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "total": total, "o": o, "g": g, "r": r, "y": y}

    def _weights(self, queries: float, keys: float) -> np.ndarray:
        d, kind = self.width, self.params["qkv"].dtype
        out = np.concatenate([self.params["qkv"], self.params["last"]], 1)
        out[:, :d] *= kind.type(queries * d**-0.5)
        out[:, d : 2 * d] *= kind.type(keys)
        out[:, 2 * d : 3 * d] = out[:, 2 * d : 3 * d] @ self.params["mix"]
        return out

    def log_probabilities(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, most: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms for each position of its target's probability, and of the chance that what
        follows begins a word (or ends the text). Blocks are worked on in parts of about ``most`` positions."""
        n = len(inputs)
        own, boundary = np.zeros(n * BLOCK, np.float32), np.zeros(n * BLOCK, np.float32)
        step, symbols, heads = max(1, most // BLOCK), self._told(), self._heads()
        for low in range(0, n, step):
            # The block before is read again, for its keys and values.
            lead = int(low > 0)
            lone = fresh[low - lead : low + step].copy()
            lone[0] |= lead > 0
            y = self._inside(inputs[low - lead : low + step], lone, symbols)["y"][lead * BLOCK :]
            place = slice(low * BLOCK, low * BLOCK + len(y))
            own[place], boundary[place] = self._scores(y, targets[low : low + step].ravel(), heads)["logs"]
        return own, boundary

    def _scores(self, y: np.ndarray, t: np.ndarray, heads: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Raised scores of the groups (``z``) with their sums and the targets' places and, in the order of the targets'
        groups' turns and for groups of several symbols only, those of the members (``z2``); and the logarithms that
        :meth:`log_probabilities` gives. The scores hold until the next call."""
        members, kind, (out, weights) = self.symbols.members, y.dtype, heads
        group = t // members
        turn = self.turn[group]
        order = np.argsort(turn, kind="stable")
        ends = np.cumsum(np.bincount(turn, minlength=self.groups))[: self.choices]
        n = int(ends[-1]) if len(ends) else 0
        z = np.matmul(y, out, out=self._space("z", (len(t), self.groups), kind))
        order = order[:n]
        ys, z2, low = y.take(order, 0), self._space("z2", (n, members), kind), 0
        for g, high in zip(self.turns.tolist(), ends.tolist(), strict=False):
            if high > low:
                np.matmul(ys[low:high], weights[g], out=z2[low:high])
                low = high
        raised(z), raised(z2)
        at = np.arange(len(t)) * self.groups + group
        at2 = np.arange(n) * members + (t - group * members)[order]
        sums = z @ np.stack([np.ones(self.groups), self.symbols.begins], 1).astype(kind)
        total, total2 = sums[:, 0], z2 @ np.ones(members, kind)
        own = np.log(z.reshape(-1)[at] / total)
        own[order] += np.log(z2.reshape(-1)[at2] / total2)
        return {"z": z, "z2": z2, "at": at, "at2": at2, "order": order, "ys": ys, "ends": ends, "total": total, "total2": total2, "logs": (own, np.log(sums[:, 1] / total))}

    def gradients(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, real: np.ndarray, through: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss in nats over the real positions, and its gradients; without ``through``, queries, keys and
        values count as given, and their parameters have none."""
        return self._learned(inputs, fresh, targets, real, through)[:2]

    def _learned(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, real: np.ndarray, through: bool) -> tuple[float, dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The same, with what :meth:`log_probabilities` gives."""
        p, f = self.params, self._inside(inputs, fresh, self._told())
        n, d, y = len(inputs), self.width, f["y"]
        kind = y.dtype
        weight = real.ravel().astype(kind)
        weight /= max(1.0, float(weight.sum()))
        s = self._scores(y, targets.ravel(), self._heads())
        z, z2, order, ys, ends = s["z"], s["z2"], s["order"], s["ys"], s["ends"]
        loss = -float(s["logs"][0] @ weight)
        sorted_weight = weight[order]
        z *= (weight / s["total"])[:, None]
        z.reshape(-1)[s["at"]] -= weight
        z2 *= (sorted_weight / s["total2"])[:, None]
        z2.reshape(-1)[s["at2"]] -= sorted_weight
        ones = np.ones(len(z), kind)
        out, own = y.T @ z, np.zeros((self.groups, d + 1, z2.shape[1]), kind)
        dy = z @ p["out"].T
        dys, low = np.zeros((len(order) + 1, d), kind), 0
        for g, high in zip(self.turns.tolist(), ends.tolist(), strict=False):
            if high > low:
                part = z2[low:high]
                np.matmul(ys[low:high].T, part, out=own[g])
                np.matmul(part, p["own"][g].T, out=dys[low:high])
                low = high
        grad = {"out": out[:d], "out0": out[d], "own": own[:, :d], "own0": own[:, d]}
        # Back in the order of the positions; those without a choice in their group take the last row, of zeros.
        place = np.full(len(z), len(order))
        place[order] = np.arange(len(order))
        dy += dys.take(place, 0)
        grad["down"], grad["down0"] = f["r"].T @ dy, ones @ dy
        du = dy @ p["down"].T
        du *= f["r"] > 0
        grad["up"], grad["up0"] = f["g"].T @ du, ones @ du
        dg = du @ p["up"].T
        dg += dy
        dx = self._attended(grad, f, dg, fresh, through)
        dx += dg
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else flat, kind="stable")
        kinds = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        grad["embed"] = np.zeros_like(p["embed"])
        grad["embed"][kinds[begin]] = np.add.reduceat(dx.take(order, 0), begin, 0)
        return loss, grad, s["logs"]

    def _attended(self, grad: dict[str, np.ndarray], f: dict[str, np.ndarray], dg: np.ndarray, fresh: np.ndarray, through: bool) -> np.ndarray:
        """Gradients through the attention and to the position after: adds those of their parameters, returns that of
        the embedded inputs."""
        p, n, d, kind = self.params, len(fresh), self.width, dg.dtype
        scale = _units(kind)[0]
        do = dg / f["total"][:, None]
        a = f["a"]
        # The sum of da * a over the keys is that of do * o over the width.
        less = ((do * f["o"]) @ np.ones(d, kind)).reshape(n, BLOCK, 1)
        do = do.reshape(n, BLOCK, d)
        back, both = self._space("back", (n, BLOCK, 4 * d), kind), self._space("both", (n, 2 * BLOCK, 2 * d), kind)
        np.matmul(a.transpose(0, 2, 1), do, out=both[..., d:])
        da = np.matmul(do, f["v"].transpose(0, 2, 1), out=self._space("da", a.shape, kind))
        da -= less
        da *= a
        np.matmul(da, f["k"], out=back[..., :d])  # too large by the units of the keys
        np.matmul(da.transpose(0, 2, 1), f["q"], out=both[..., :d])
        # Keys and values get from their own block and from the one after it; a fresh block gives nothing to the one before.
        np.add(both[:-1, BLOCK:], both[1:, :BLOCK], out=back[:-1, :, d : 3 * d])
        back[-1, :, d : 3 * d] = both[-1, BLOCK:]
        back = back.reshape(-1, 4 * d)
        # What each input gave the position after it, unless that begins a fresh block.
        back[:-1, 3 * d :] = dg[1:]
        back[np.append(np.flatnonzero(fresh[1:]) + 1, n) * BLOCK - 1, 3 * d :] = 0
        own = f["x"].T @ back
        grad["last"], mixed = own[:, 3 * d :], own[:, 2 * d : 3 * d]
        grad["mix"] = p["qkv"][:, 2 * d :].T @ mixed
        if through:
            own[:, :d] *= kind.type(d**-0.5 / scale)
            grad["qkv"] = np.concatenate([own[:, : 2 * d], mixed @ p["mix"].T], 1)
            sums = (np.ones(n, kind) @ da.reshape(n, -1)).reshape(BLOCK, 2 * BLOCK)
            grad["bias"] = np.bincount(self.apart.ravel(), np.where(self.seen, sums, 0).ravel(), 2 * BLOCK).astype(kind)
        else:
            back[:, : 3 * d] = 0
        return back @ self._weights(1 / scale, 1).T

    def train(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, real: np.ndarray, updates: int | None = None, batch: int = 128, run: int = 8, rate: float = 4e-3, through: bool = True, seed: int = 11, told: tuple[np.ndarray, np.ndarray] | None = None) -> list[float]:
        """Adam with a falling rate; a batch is ``batch`` blocks, drawn in runs of ``run`` neighbours.

        ``updates`` steps in as many passes as they need, or one pass over all blocks. ``told`` takes what
        :meth:`log_probabilities` gives for each position as the model stood before it learned from it.
        """
        rng, losses = np.random.default_rng(seed), []
        names = sorted(self.params)
        values = self.flat()
        self.params = self._named(values)
        first, second = np.zeros_like(values), np.zeros_like(values)
        runs = -(-len(inputs) // run)
        each = max(1, batch // run)
        updates = -(-runs // each) if updates is None else updates
        order = np.zeros(0, np.int64)
        for step in range(1, updates + 1):
            if not len(order):
                order = rng.permutation(runs)
            now, order = order[:each], order[each:]
            rows = (now[:, None] * run + np.arange(run)).ravel()
            lone = np.zeros((len(now), run), bool)
            lone[:, 0] = True
            inside = rows < len(inputs)
            rows, lone = rows[inside], lone.ravel()[inside] | fresh[rows[inside]]
            loss, grad, logs = self._learned(inputs[rows], lone, targets[rows], real[rows], through)
            losses.append(loss)
            for whole, own in zip(told or (), logs, strict=False):
                whole.reshape(-1, BLOCK)[rows] = own.reshape(-1, BLOCK)
            g = np.concatenate([grad[k].ravel() if k in grad else np.zeros(self.params[k].size, values.dtype) for k in names])
            g /= g.dtype.type(max(1.0, float(np.sqrt(g @ g))))
            speed = rate * (1 - 0.9 * step / updates)
            first *= 0.9
            first += 0.1 * g
            g *= g
            second *= 0.99
            second += 0.01 * g
            np.sqrt(second / (1 - 0.99**step), out=g)
            g += 1e-8
            np.divide(first, g, out=g)
            g *= speed / (1 - 0.9**step)
            values -= g
        return losses

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in sorted(self.params)])

    def _named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        params, at = {}, 0
        for k in sorted(self.params):
            size = self.params[k].size
            params[k] = flat[at : at + size].reshape(self.params[k].shape)
            at += size
        return params

    def filled(self, flat: np.ndarray) -> AttentionModel:
        """A model of this shape with other values."""
        return AttentionModel(self._named(flat.astype(np.float32)), self.symbols)


def blocks(flat: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of symbols that stand one after the other in ``flat``, as blocks in order: inputs, whether a
    block is its sequence's first, targets, which positions are real, and each position's place in ``flat``.

    A position's input is the symbol before its target, before a sequence it is ``end``.
    """
    counts = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (number * BLOCK)[:, None] + np.arange(BLOCK)
    token = (np.cumsum(lengths) - lengths)[owner][:, None] + place
    real = place < lengths[owner][:, None]
    padded = np.concatenate([[end], flat, np.full(BLOCK, end, flat.dtype)])
    targets, inputs = padded[token + 1], padded[token]
    inputs[number == 0, 0] = end
    return np.where(real, inputs, end), number == 0, np.where(real, targets, end), real, token
