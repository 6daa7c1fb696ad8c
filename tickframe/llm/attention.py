"""A small causal self-attention model over subword ids, in numpy.

Ids come from the first merges of a byte-level vocabulary, a public one or one learned from counted words, so any bytes can be
spelled; every word is spelled with a space before it, and one more id ends a text and opens the next. The model has one attention head with a learned bias
for each distance, and a two-level output: the class of the next id, then the id within its class. Ids are put into
classes by their frequency in the whole corpus, and the output biases start at the corpus's log frequencies; embeddings,
attention and output weights are trained by Adam on windows of drawn texts.

Scoring cuts a text into windows of WINDOW positions that overlap by OVERLAP: a window scores only the positions that the
one before has not, each of which then sees at least OVERLAP ids before it. Windows of many texts make one batch.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Mapping
from copy import copy

import numpy as np

from tickframe.llm.tokens import Memory

IDS = 4096
CLASSES = 64
WIDTH = 32
WINDOW = 32
OVERLAP = 8
STEP_WINDOWS = 128
EPOCHS = 12
RATE = 0.01
_FAR = np.float32(-1e9)
_BACK = np.subtract(*np.indices((WINDOW, WINDOW)))  # how far the second place of a pair lies before the first
#: Scores are held within this, so that no sum of exponentials leaves single precision; they still sum to one.
HIGHEST = 70
#: A vocabulary is learned from so many of the most frequent words of so many bytes at most, their counts scaled to so many in all;
#: any word is spelled with it.
LEARN_FROM, LEARN_BYTES, LEARN_TIMES = 50_000, 100, 1_000_000
ADAM_BLOCK = 1 << 14  # weights moved at a time, so that they stay in the cache


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learned_vocabulary(counts: Mapping[bytes, int]) -> bytes:
    """The lines of a vocabulary file with IDS - 1 ranks at most: all bytes, then merges learned from counted words."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    top = sorted((x for x in counts.items() if len(x[0]) <= LEARN_BYTES), key=lambda x: (-x[1], x[0]))[:LEARN_FROM]
    scale = min(1.0, LEARN_TIMES / max(1, sum(c for _, c in top)))
    learner = Tokenizer(models.BPE())
    learner.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    learner.train_from_iterator(
        ((" " + word.decode(errors="replace")) * max(1, round(c * scale)) for word, c in top),
        trainers.BpeTrainer(vocab_size=IDS - 1, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    # the byte behind each character of a byte-level vocabulary
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
    ranks = sorted((rank, bytes(map(byte_of.__getitem__, token))) for token, rank in learner.get_vocab().items())
    return b"\n".join(base64.b64encode(token) + b" %d" % rank for rank, token in ranks)


class Subwords:
    """Ids of words under the first IDS - 1 ranks of a vocabulary, a file's path or its lines; END opens and closes every text."""

    END = IDS - 1

    def __init__(self, vocabulary: str | bytes):
        import tiktoken

        if isinstance(vocabulary, bytes):
            lines = vocabulary.split(b"\n")
        else:
            with open(vocabulary, "rb") as file:
                lines = file.read().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if int(rank) < self.END}
        #: whether an id begins a word; the end does, as a token of its own
        self.begins = np.zeros(IDS, bool)
        self.begins[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.begins[self.END] = True
        self._memory = Memory(150_000, 100_000)
        self._encoding = tiktoken.Encoding("first-merges", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, each with its END, and how many each has."""
        self._memory.trim()
        known = self._memory.of
        new = list(set().union(*texts).difference(known)) if texts else []
        if new:
            found = self._encoding.encode_to_numpy(" " + b" ".join(new).decode(errors="replace")).astype("<u2")
            edges = [*(2 * np.flatnonzero(self.begins[found])).tolist(), 2 * len(found)]
            raw = found.tobytes()
            self._memory.put(new, [raw[a:b] for a, b in zip(edges, edges[1:])])
        end = np.array([self.END], "<u2").tobytes()
        parts = [b"".join(map(known.__getitem__, words)) + end for words in texts]
        return np.frombuffer(b"".join(parts), "<u2").astype(np.int64), np.array([len(p) // 2 for p in parts], np.int64)


class Model:
    def __init__(self, counts: np.ndarray, seed: int = 3):
        """``counts`` of every id in the corpus set the classes and the output biases."""
        size = IDS // CLASSES
        order = np.argsort(-counts, kind="stable")
        self.slot = np.empty(IDS, np.int64)  # class * size + place in it
        self.slot[order] = np.arange(IDS)
        self.slot16 = self.slot.astype(np.int16)
        mass = (counts[order] + 0.5).reshape(CLASSES, size)
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        self.size = size
        self.p = {
            "e": small(IDS, WIDTH), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH),
            "r": np.zeros(WINDOW, np.float32), "uc": np.zeros((WIDTH, CLASSES), np.float32),
            "uw": np.zeros((CLASSES, WIDTH, size), np.float32),
            "bc": np.log(mass.sum(1)).astype(np.float32) - np.float32(np.log(mass.sum())),
            "bw": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
        }

    def _distances(self) -> np.ndarray:
        """The bias of every pair of places in a window; later places are out of sight."""
        return np.where(_BACK >= 0, self.p["r"][np.maximum(_BACK, 0)], _FAR)

    # --- training ------------------------------------------------------------------------------------------------

    def gradients(self, given: np.ndarray, wanted: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log-loss and its gradients over windows: ids given, ids wanted after each, and which of them count."""
        p, (b, w) = self.p, given.shape
        root = np.float32(WIDTH ** -0.5)
        qkv = np.concatenate((p["q"] * root, p["k"], p["v"]), 1)
        x = p["e"].take(given.reshape(-1), 0)
        q, k, v = np.split((x @ qkv).reshape(b, w, 3 * WIDTH), 3, 2)
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -HIGHEST, HIGHEST, out=a)
        a += self._distances()[:w, :w]
        np.exp(a, out=a)
        one = np.ones(w, a.dtype)
        a *= (1 / (a.reshape(-1, w) @ one)).reshape(b, w, 1)
        # places in the order of the wanted ids' classes, so that a class is a slice
        slot = self.slot16.take(wanted.reshape(-1))
        order = np.argsort(slot, kind="stable")
        c, j = np.divmod(slot.take(order).astype(np.int64), self.size)
        use = counted.reshape(-1).take(order).astype(np.float32)
        n = max(1.0, float(use.sum()))
        h = a @ v
        h = h.reshape(-1, WIDTH)
        h += x
        h = h.take(order, 0)
        weight = use / np.float32(n)

        def softmax(logits: np.ndarray, wanted: np.ndarray) -> float:
            """The loss; the logits become their gradients."""
            np.clip(logits, -HIGHEST, HIGHEST, out=logits)
            flat, at = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + wanted
            right = flat.take(at)
            np.exp(logits, out=logits)
            total = logits @ np.ones(logits.shape[1], logits.dtype)
            logits *= (weight / total)[:, None]
            flat[at] -= weight
            return float(((np.log(total) - right) * use).sum())

        pc = h @ p["uc"]
        pc += p["bc"]
        loss = softmax(pc, c)
        edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        slices = [(at, slice(i, j)) for at, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
        pw = np.empty((len(c), self.size), pc.dtype)
        for of, at in slices:
            part = pw[at]
            np.matmul(h[at], p["uw"][of], out=part)
            part += p["bw"][of]
        loss += softmax(pw, j)
        each = np.ones(len(c), pc.dtype)
        g = {"uc": h.T @ pc, "bc": each @ pc, "uw": np.zeros_like(p["uw"]), "bw": np.zeros_like(p["bw"])}
        dh = pc @ p["uc"].T
        for of, at in slices:
            part, to = pw[at], dh[at]
            np.matmul(h[at].T, part, out=g["uw"][of])
            np.matmul(each[at], part, out=g["bw"][of])
            to += part @ p["uw"][of].T
        dx = np.empty_like(dh)
        dx[order] = dh
        dh = dx.reshape(b, w, WIDTH)
        da = dh @ v.transpose(0, 2, 1)
        da *= a
        dqkv = np.empty((b, w, 3 * WIDTH), da.dtype)
        dqkv[:, :, 2 * WIDTH:] = a.transpose(0, 2, 1) @ dh
        a *= (da.reshape(-1, w) @ one).reshape(b, w, 1)
        da -= a
        back = np.maximum(_BACK[:w, :w], 0)  # later places have no weight
        g["r"] = np.bincount(back.reshape(-1), da.sum(0).reshape(-1), WINDOW).astype(p["r"].dtype)
        dqkv[:, :, :WIDTH] = da @ k
        dqkv[:, :, WIDTH:2 * WIDTH] = da.transpose(0, 2, 1) @ q
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        g["q"], g["k"], g["v"] = np.split(x.T @ dqkv, 3, 1)
        g["q"] *= root
        dx += dqkv @ qkv.T
        g["e"] = np.zeros_like(p["e"])
        ids = given.reshape(-1).astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ids = ids.take(order)
        heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        g["e"][ids[heads]] = np.add.reduceat(dx.take(order, 0), heads, 0)
        return loss / n, g

    def copy(self) -> Model:
        """A model of its own with the same weights."""
        other = copy(self)
        other.p = {k: v.copy() for k, v in self.p.items()}
        return other

    def packed(self) -> bytes:
        """All weights in a row, single precision."""
        return b"".join(v.astype(np.float32).tobytes() for v in self.p.values())

    def unpack(self, weights: bytes) -> None:
        flat, at = np.frombuffer(weights, np.float32), 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).copy()
            at += v.size

    def fit(self, ids: np.ndarray, epochs: int = EPOCHS, seed: int = 5, span: tuple[float, float] = (0.0, 1.0)) -> list[float]:
        """Adam over shuffled windows of texts' ids, an END after each; the loss of every epoch. The rate falls in a line from
        RATE to nothing; ``span`` is the part of that line which these epochs take."""
        stream = np.concatenate(([Subwords.END], ids))
        n = (len(stream) - 1) // WINDOW
        if n < 1:
            return []
        given, wanted = stream[:n * WINDOW].reshape(n, WINDOW), stream[1:n * WINDOW + 1].reshape(n, WINDOW)
        counted = np.ones_like(given, bool)

        def blocks(values: np.ndarray) -> list[np.ndarray]:
            flat = np.ascontiguousarray(values).reshape(-1)
            return [flat[at:at + ADAM_BLOCK] for at in range(0, len(flat), ADAM_BLOCK)]

        self.p = {k: np.ascontiguousarray(v) for k, v in self.p.items()}
        m, s, own = ({k: blocks(v) for k, v in of.items()} for of in (*({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), self.p))
        draw, t, said = np.random.default_rng(seed), 0, []
        total = epochs * (-(-n // STEP_WINDOWS))
        for _ in range(epochs):
            losses = []
            order = draw.permutation(n)
            for at in range(0, n, STEP_WINDOWS):
                pick = order[at:at + STEP_WINDOWS]
                loss, g = self.gradients(given[pick], wanted[pick], counted[pick])
                losses.append(loss)
                t += 1
                rate = RATE * (1 - span[0] - (span[1] - span[0]) * t / (total + 1)) / (1 - 0.9 ** t) * (1 - 0.98 ** t) ** 0.5
                # m and s are sums, 10 and 50 times the means
                rate, least = np.float32(rate * 0.1 / 0.02 ** 0.5), np.float32(1e-8 / 0.02 ** 0.5)
                for name, grad in g.items():
                    for d, mean, square, value in zip(blocks(grad), m[name], s[name], own[name]):
                        mean *= np.float32(0.9)
                        mean += d
                        square *= np.float32(0.98)
                        d *= d
                        square += d
                        np.sqrt(square, out=d)
                        d += least
                        np.divide(mean, d, out=d)
                        d *= rate
                        value -= d
            said.append(float(np.mean(losses)))
        return said

    # --- scoring -------------------------------------------------------------------------------------------------

    def ready(self) -> None:
        """Tables by id of all that depends on one id: its embedding, query, key and value."""
        p, root = self.p, np.float32(WIDTH ** -0.5)
        self._x = np.ascontiguousarray(p["e"])
        self._q = p["e"] @ p["q"] * root
        self._k = p["e"] @ p["k"]
        self._v = np.concatenate((p["e"] @ p["v"], np.ones((IDS, 1), np.float32)), 1)
        self._d = self._distances()

    def _states(self, given: np.ndarray) -> np.ndarray:
        s = self._q.take(given, 0) @ self._k.take(given, 0).transpose(0, 2, 1)
        np.clip(s, -HIGHEST, HIGHEST, out=s)
        s += self._d
        np.exp(s, out=s)
        o = s @ self._v.take(given, 0)
        h = self._x.take(given, 0)
        h += o[:, :, :WIDTH] / o[:, :, WIDTH:]
        return h

    def _log_total(self, logits: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of the rows' exponentials; the logits are used up."""
        return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))

    def _log_of(self, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The natural log-probability of the ids wanted after the states."""
        p, n = self.p, len(wanted)
        slot = self.slot16.take(wanted)
        order = np.argsort(slot, kind="stable")
        h, slot = h.take(order, 0), slot.take(order).astype(np.int64)
        c, j = np.divmod(slot, self.size)
        logits = h @ p["uc"]
        logits += p["bc"]
        np.clip(logits, -HIGHEST, HIGHEST, out=logits)
        out = logits.reshape(-1).take(np.arange(n) * CLASSES + c)
        out -= self._log_total(logits)
        edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        inner = np.empty((n, self.size), np.float32)
        for one, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                np.matmul(h[a:b], p["uw"][one], out=inner[a:b])
                inner[a:b] += p["bw"][one]
        np.clip(inner, -HIGHEST, HIGHEST, out=inner)
        out += inner.reshape(-1).take(np.arange(n) * self.size + j)
        out -= self._log_total(inner)
        back = np.empty_like(out)
        back[order] = out
        return back

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray, chunk: int = 32, group: int = 256) -> np.ndarray:
        """The natural log-probability of every id of texts in a row, an END after each; ``sizes`` count the END."""
        stride = WINDOW - OVERLAP
        # what an id follows: the END of a text opens the next one
        stream = np.concatenate(([Subwords.END], ids, [Subwords.END] * (WINDOW + 1))).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        counts = np.maximum(1, -(-(sizes - OVERLAP) // stride))
        text = np.repeat(np.arange(len(sizes)), counts)
        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        opened = starts[text] + turn * stride
        first = np.where(turn > 0, OVERLAP, 0)
        last = np.minimum(WINDOW, sizes[text] - turn * stride)
        out = np.empty(int(sizes.sum()))
        places = np.arange(WINDOW)
        for g in range(0, len(opened), group):
            at = opened[g:g + group, None] + places
            counted = np.flatnonzero((places >= first[g:g + group, None]) & (places < last[g:g + group, None]))
            given = stream.take(at)
            states = np.empty((len(counted), WIDTH), np.float32)
            edges = np.searchsorted(counted, np.arange(0, len(given) + chunk, chunk) * WINDOW).tolist()
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                h = self._states(given[i * chunk:(i + 1) * chunk]).reshape(-1, WIDTH)
                h.take(counted[a:b] - i * chunk * WINDOW, 0, out=states[a:b])
            to = at.reshape(-1).take(counted)
            out[to] = self._log_of(states, stream.take(to + 1))
        return out
