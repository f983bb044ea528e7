"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A word with a letter, and a space on either side, is one sequence of bytes. Two gated recurrent layers read it, one from
the left and one from the right; at every position their states together give log-odds of each language,
and a document's probabilities come from pooling the log-odds of all positions of all such words. No state
crosses a space: reading running text costs over a microsecond a byte and direction in numpy (README), and as
a word's positions depend on the word alone, each distinct word of a run of documents is read once and
counted as often as it occurs; texts are read whole. Training unrolls the network over every position
and sends the error back through time, in both directions; the error is that of the pooled word.

The network is fitted on at most SAMPLE labelled documents, evenly by language, so a rare language is learnt as
well; all words of their whole texts are read: in every epoch each distinct word of a language once, or as often as it
takes for each language to have as many as the one with the most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import features as X
from quern.llm.shared import cut

SAMPLE = 600
HIDDEN = 16
EMBED = 12
#: Rounds over all words, or more until READ words have been read.
EPOCHS = 3
READ = 60_000
BATCH = 128
SEED = 9
#: Bytes of a word read as one sequence; a longer word is read in pieces of this length, all of them.
PIECE = 24

_SPACE = 32
#: Bytes that can be part of a letter: A-Z, a-z and those of code points beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Weights of both directions (index 0 from the left, 1 from the right) and of the output."""

    def __init__(self, classes: list[str]) -> None:
        rng = np.random.default_rng(SEED)
        k = max(1, len(classes))
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.classes = classes
        self.p = {
            "e": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32),
            "x": draw(2, EMBED, 3 * HIDDEN),
            "h": draw(2, HIDDEN, 3 * HIDDEN),
            "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "o": draw(2 * HIDDEN, k),
            "c": np.zeros(k, np.float32),
        }
        self.prior = np.zeros(k, np.float32)

    def states(self, ids: np.ndarray, mask: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """States (time, words, HIDDEN) of one direction over (words, time) bytes; a state passes masked places unchanged."""
        p = self.p
        n, t = ids.shape
        table = p["e"] @ p["x"][side] + p["b"][side]  # what each byte brings to the gates
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        u = p["h"][side]
        for s in range(t) if side == 0 else range(t - 1, -1, -1):
            xs = table[ids[:, s]]
            hu = h @ u
            z = _gate(xs[:, :HIDDEN] + hu[:, :HIDDEN])
            r = _gate(xs[:, HIDDEN : 2 * HIDDEN] + hu[:, HIDDEN : 2 * HIDDEN])
            g = np.tanh(xs[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[:, s : s + 1]
            new = h + m * z * (g - h)
            if keep is not None:
                keep.append((s, h, z, r, g, hu[:, 2 * HIDDEN :], m))
            h = new
            out[s] = h
        return out

    def odds(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-odds of each class summed over a word's positions (words, classes)."""
        both = np.concatenate((self.states(ids, mask, 0), self.states(ids, mask, 1)), axis=2)
        each = both @ self.p["o"] + self.p["c"]
        each -= each.max(axis=2, keepdims=True)
        each -= np.log(np.exp(each).sum(axis=2, keepdims=True))
        return (each * mask.T[:, :, None]).sum(axis=0)

    def gradient(self, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradient: the mean over words of the cross-entropy of the class at each position."""
        p = self.p
        n = len(ids)
        tapes: list[list] = [[], []]
        hs = [self.states(ids, mask, side, tapes[side]) for side in (0, 1)]
        both = np.concatenate(hs, axis=2)
        each = both @ p["o"] + p["c"]
        each -= each.max(axis=2, keepdims=True)
        q = np.exp(each)
        q /= q.sum(axis=2, keepdims=True)
        share = (mask / mask.sum(axis=1, keepdims=True)).T[:, :, None] / n
        goal = np.zeros_like(q)
        goal[:, np.arange(n), labels] = 1
        loss = float(-(np.log(np.maximum(q[:, np.arange(n), labels], 1e-9))[:, :, None] * share).sum())
        d = (q - goal) * share
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = np.einsum("tnh,tnk->hk", both, d, optimize=True)
        g["c"] = d.sum(axis=(0, 1))
        back = d @ p["o"].T
        for side in (0, 1):
            u = p["h"][side]
            dh = np.zeros((n, HIDDEN), np.float32)
            dtable = np.zeros((256, 3 * HIDDEN), np.float32)
            for s, h, z, r, c, hc, m in reversed(tapes[side]):
                dh = dh + back[s][:, side * HIDDEN : (side + 1) * HIDDEN]
                dz = dh * m * (c - h) * z * (1 - z)
                dc = dh * m * z * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                gates = np.concatenate((dz, dr, dc), axis=1)
                np.add.at(dtable, ids[:, s], gates)
                on_h = np.concatenate((dz, dr, dc * r), axis=1)
                g["h"][side] += h.T @ on_h
                dh = dh * (1 - m * z) + on_h @ u.T
            g["x"][side] = p["e"].T @ dtable
            g["b"][side] = dtable.sum(axis=0)
            g["e"] += dtable @ p["x"][side].T
        return loss, g


def pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bytes, mask) of words cut in pieces of PIECE bytes with a space on either side."""
    many = np.maximum(-(-(ends - starts) // PIECE), 1)
    word = np.repeat(np.arange(len(starts)), many)
    part = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    lo = starts[word] + part * PIECE
    for _ in range(3):  # a piece begins with a character, never within one
        lo = lo - ((part > 0) & ((buf[np.minimum(lo, len(buf) - 1)] & 0xC0) == 0x80))
    hi = np.append(lo[1:], 0)
    last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
    hi = np.where(last, ends[word], hi[: len(word)])
    return word, lo, hi - lo, part


def grid(buf: np.ndarray, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, longest + 2) bytes, a space before and after each piece, and which places count."""
    width = int(length.max()) + 2
    at = np.arange(width) - 1
    inside = (at >= 0) & (at < length[:, None])
    where = np.where(inside, lo[:, None] + at, 0)
    ids = np.where(inside, buf[where], np.uint8(_SPACE))
    mask = (np.arange(width) < length[:, None] + 2).astype(np.float32)
    return ids, mask


def word_odds(net: Network, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Summed log-odds of each word; pieces of like length are read together."""
    word, lo, length, _ = pieces(buf, starts, ends)
    out = np.zeros((len(starts), len(net.prior)), np.float64)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 4096):
        pick = order[at : at + 4096]
        ids, mask = grid(buf, lo[pick], length[pick])
        np.add.at(out, word[pick], net.odds(ids, mask))
    return out


def lettered(words) -> np.ndarray:
    """Which words hold a byte of a letter."""
    if len(words.starts) == 0:
        return np.zeros(0, bool)
    total = np.concatenate(([0], np.cumsum(_LETTER[words.buf])))
    return total[words.ends] > total[words.starts]


class Known:
    """Log-odds of words already read, sorted by hash; emptied when it holds MOST words."""

    MOST = 400_000

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.names, self.odds = np.zeros(0, np.uint64), np.zeros((0, len(self.net.prior)))

    def look(self, names: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != names[inside]
        out = np.zeros((len(names), len(self.net.prior)))
        out[~new] = self.odds[at[~new]]
        if new.any():
            out[new] = word_odds(self.net, buf, starts[new], ends[new])
            if len(self.names) + int(new.sum()) > self.MOST:
                self.clear()
            merged = np.concatenate((self.names, names[new]))
            order = np.argsort(merged, kind="stable")
            self.names, self.odds = merged[order], np.concatenate((self.odds, out[new]))[order]
        return out


def pooled(net: Network, words, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, classes) probabilities, and which documents hold a letter.

    Positions of one word say much the same, so pooling takes the mean log-odds per position times the
    square root of their number.
    """
    n = len(words.first) - 1
    use = lettered(words)
    doc = np.repeat(np.arange(n), np.diff(words.first))[use]
    names, first, back = np.unique(words.hashes[use], return_index=True, return_inverse=True)
    starts, ends = words.starts[use][first], words.ends[use][first]
    known = known or Known(net)
    odds = known.look(names, words.buf, starts, ends)
    length = (ends - starts + 2).astype(float)
    places = np.bincount(doc, length[back], minlength=n)
    sums = np.stack([np.bincount(doc, odds[back, k], minlength=n) for k in range(odds.shape[1])], axis=1)
    mean = sums / np.maximum(places, 1)[:, None] * np.sqrt(np.maximum(places, 1))[:, None] + net.prior
    mean -= mean.max(axis=1, keepdims=True)
    q = np.exp(mean)
    return q / q.sum(axis=1, keepdims=True), np.bincount(doc, minlength=n) > 0


def fit(texts: list[bytes], langs: list[str]) -> Network:
    """Train on words of labelled texts: a word's label is its document's language."""
    from quern.llm import words as W

    classes = sorted(set(langs))
    net = Network(classes)
    if len(classes) < 2:
        return net
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = W.cut(np.frombuffer(b"".join(texts), np.uint8), offs)
    use = np.flatnonzero(lettered(words))
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    label = np.array([classes.index(x) for x in langs])[owner]
    rng = np.random.default_rng(SEED)
    _, once = np.unique(np.rec.fromarrays([label[use], words.hashes[use]]), return_index=True)
    use = use[once]
    # words of a language with fewer are read more often, so none is favoured by how much was written in it
    own = [use[label[use] == k] for k in range(len(classes))]
    most = max(map(len, own))
    use = np.concatenate([np.resize(rng.permutation(x), most) for x in own if len(x)])
    word, lo, length, _ = pieces(words.buf, words.starts[use], words.ends[use])
    label = label[use][word]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-READ // max(len(lo), 1)))
    for epoch in range(epochs):
        # batches of like length, in random order
        order = np.lexsort((rng.random(len(lo)), length))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rate = 0.01 / (1 + epoch * EPOCHS / epochs)
        for k in rng.permutation(len(batches)):
            pick = batches[k]
            ids, mask = grid(words.buf, lo[pick], length[pick])
            _, g = net.gradient(ids, mask, label[pick])
            step += 1
            for name, p in net.p.items():
                m, s = moments[name]
                m += 0.1 * (g[name] - m)
                s += 0.001 * (g[name] ** 2 - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on (doc_id, text, lang) rows with a language: at most `sample`, evenly by language and then by a hash of the id."""
    rows = X.even_sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL"), sample, "lang")
    held = cut(rows.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), "language-sample").orderBy("doc_id", "text").toArrow()
    return fit([t.encode() for t in held.column("text").to_pylist()], held.column("lang").to_pylist())


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs`: `und` with score 0 where the text is null or has no letter."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        names = np.array([*net.classes, "und"], object)
        known = Known(net)
        for batch in batches:
            has = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, buf, offs in X.W.slices(batch.column(1), 1 << 20):
                q, some = pooled(net, X.W.cut(buf, offs), known)
                some &= has[a:b] & (len(net.classes) > 0)
                best = np.where(some, q.argmax(axis=1), len(net.classes))
                value = np.where(some, q.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(value)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("text").cast("string").alias("text"), "_letters").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
