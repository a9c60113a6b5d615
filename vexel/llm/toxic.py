"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel counts common subsequences of letters, each weighted down by the length
it spans, so letters put in between or left out cost little. A sentence is a bag of
units (its words without punctuation, and its runs of single letters); the machine
scores units, and a sentence has the score of its worst. It is trained on the
sentences of labelled documents: witnesses are the units that toxic documents have
significantly more often, while the units of the others are harmless. As harmless
text has some units like witnesses by chance, a document is called toxic only if its
units above the cut are likelier in a toxic text of its length than in a harmless one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, need, slices
from vexel.llm.textnum import LOWER, SPACE, WORD, joined, span_hashes, spans

by_value(__name__, "vexel.llm.common", "vexel.llm.textnum")

#: At most so many labelled documents train the machine.
SAMPLE = 4000
DECAY = 0.6
ORDER = 3
TOXIC_MARKS, PLAIN_MARKS = 24, 24
#: Units longer than this are read in overlapping windows.
WINDOW, STRIDE = 24, 12
#: A witness must be in so many distinct toxic sentences, and so many times as frequent there as elsewhere.
LEAST, RATIO = 4, 12.0
#: Share of witnesses that may be chance.
FALSE = 0.05
#: Each witness has a landmark of at least this kernel with it.
ALIKE = 0.9
#: Plain examples of the machine: so many of the labelled documents' units most like witnesses, and so many others by chance.
NEAR_PLAIN, OTHER_PLAIN = 6000, 6000
#: Text that is scored in one go, to bound a task's memory.
BATCH_BYTES = 2 << 20
#: The cut is not below this.
LOWEST = 0.25

#: Look-alikes are read as letters; other marks inside a word are dropped.
FOLD = LOWER.copy()
for _a, _b in zip(b"013457@$", b"oieastas", strict=True):
    FOLD[_a] = _b
KEEP = WORD.copy()
KEEP[[ord("@"), ord("$")]] = True


def units(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, ends, text, sentence) of every unit; letters are folded bytes, sentences end at . ! ? or a line end."""
    data, at = joined(texts)
    inside = ~SPACE[data]
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    stop = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        closes = (data == 46) | (data == 33) | (data == 63)
        stop[:-1] = closes[:-1] & SPACE[data[1:]]
        stop |= data == 10
    sentence = np.cumsum(stop, dtype=np.int32) - stop
    s, e = spans(inside, at)
    kept = KEEP[data] & inside
    count = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(kept, out=count[1:], dtype=np.int32)
    a, b = count[s].astype(np.int64), count[e].astype(np.int64)
    s, a, b = s[b > a], a[b > a], b[b > a]
    text, sent = owner[s], sentence[s].astype(np.int64) + owner[s]
    if len(a) > 1:
        # Runs of units of one letter within a text are one unit.
        single = (b - a) == 1
        joinup = single[1:] & single[:-1] & (text[1:] == text[:-1])
        first = np.concatenate(([True], ~joinup))
        last = np.concatenate((~joinup, [True]))
        a, b, text, sent = a[first], b[last], text[first], sent[first]
    letters = FOLD[data[kept]]
    long = b - a > WINDOW
    if long.any():
        more = [(x, min(x + WINDOW, j), t, q) for i, j, t, q in zip(a[long], b[long], text[long], sent[long], strict=True) for x in range(i, max(i + 1, j - STRIDE), STRIDE)]
        w = np.array(more, dtype=np.int64)
        a, b, text, sent = (np.concatenate((u[~long], w[:, k])) for k, u in enumerate((a, b, text, sent)))
        order = np.argsort(a, kind="stable")
        a, b, text, sent = a[order], b[order], text[order], sent[order]
    return letters, a, b, text, sent


def unit_hashes(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Windows of a long unit overlap only with the next, so every other unit is disjoint."""
    out = np.empty(len(a), dtype=np.uint64)
    for k in (0, 1):
        out[k::2] = span_hashes(letters, a[k::2], b[k::2])
    return out


#: Symbols of the kernel: 0 for none, then letters, digits and the 64 continuation bytes; the lead bytes of multi-byte characters count as none.
SYMBOLS = 102
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = np.arange(27, 37)
SYMBOL[128:192] = np.arange(37, 101)
SYMBOL[[ord("@"), ord("$")]] = 101


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k below n, and the weight decay ** (letters spanned)."""
    i, j, k = (np.array(c, dtype=np.int64) for c in zip(*itertools.combinations(range(n), ORDER), strict=True))
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float64)


def by_length(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which units, the codes of their subsequences of three letters, the weights of these), for units of equal length at a time."""
    n = b - a
    symbols = SYMBOL[letters]
    for length in range(ORDER, WINDOW + 1):
        some = np.flatnonzero(n == length)
        if not len(some):
            continue
        i, j, k, w = _triples(length)
        step = max(1, 500_000 // len(i))
        for q in range(0, len(some), step):
            part = some[q : q + step]
            x = symbols[a[part][:, None] + np.arange(length)]
            x0, x1, x2 = x[:, i], x[:, j], x[:, k]
            code = (x0 * SYMBOLS + x1) * SYMBOLS + x2
            code[(x0 == 0) | (x1 == 0) | (x2 == 0)] = 0
            yield part, code, w


def self_kernel(code: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The kernel of each unit with itself: subsequences that occur more than once count together."""
    key = (np.arange(len(code))[:, None] * SYMBOLS**3 + code).ravel()
    found, inv = np.unique(key, return_inverse=True)
    sums = np.bincount(inv, weights=np.broadcast_to(w, code.shape).ravel())
    sums[found % SYMBOLS**3 == 0] = 0
    return np.maximum(np.bincount(found // SYMBOLS**3, weights=sums * sums, minlength=len(code)), 1e-12)


def _explicit(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    return letters, end - [len(w) for w in words], end


def features(words: list[bytes], marks: list[bytes]) -> np.ndarray:
    """The normalised gap-weighted subsequence kernel of words and landmarks, over subsequences of three letters."""
    letters, a, b = _explicit(marks)
    rows, codes, values = [], [], []
    for part, code, w in by_length(letters, a, b):
        rows.append(np.repeat(part, code.shape[1]))
        codes.append(code.ravel())
        values.append((w / np.sqrt(self_kernel(code, w))[:, None]).ravel())
    rows, codes, values = np.concatenate(rows), np.concatenate(codes), np.concatenate(values)
    known = np.unique(codes[codes > 0])
    at = np.full(SYMBOLS**3, len(known), dtype=np.int64)
    at[known] = np.arange(len(known))
    z = np.zeros((len(marks), len(known) + 1))
    np.add.at(z, (rows, at[codes]), values)
    z[:, -1] = 0
    out = np.zeros((len(words), len(marks)))
    letters, a, b = _explicit(words)
    for part, code, w in by_length(letters, a, b):
        for q in range(0, len(part), 400):
            c = code[q : q + 400]
            cell = at[c] + np.arange(len(c))[:, None] * (len(known) + 1)
            x = np.bincount(cell.ravel(), weights=np.broadcast_to(w, c.shape).ravel(), minlength=len(c) * (len(known) + 1)).reshape(len(c), -1)
            out[part[q : q + 400]] = x @ z.T / np.sqrt(self_kernel(c, w))[:, None]
    return out


@dataclass
class Machine:
    """marks: landmarks, the first ``toxic`` of them witnesses. weight: of the normalised kernel with each, Nyström map and hyperplane in one.

    usual, vile: the values above the cut of units of harmless and of toxic documents, rising, for the witness each is most
    like; ``calm`` and ``ill`` are the units that were read of either kind. enough: the evidence a toxic document has at least.
    """

    marks: list[bytes]
    weight: np.ndarray
    bias: float
    toxic: int = 0
    cut: float = 0.0
    usual: list[np.ndarray] = field(default_factory=list)
    vile: list[np.ndarray] = field(default_factory=list)
    calm: int = 1
    ill: int = 1
    enough: float = 0.0

    def table(self) -> np.ndarray:
        """The machine as a weight of every subsequence of three letters: the kernel with all landmarks summed up at once."""
        out = np.zeros(SYMBOLS**3)
        letters, a, b = _explicit(self.marks)
        for part, code, w in by_length(letters, a, b):
            np.add.at(out, code.ravel(), (self.weight[part][:, None] * w / np.sqrt(self_kernel(code, w))[:, None]).ravel())
        out[0] = 0
        return out


def score_units(machine: Machine, table: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray, above: float = -np.inf) -> np.ndarray:
    """The machine's value of each unit; the bias for a unit of fewer than three letters.

    Values not above ``above`` may be given as a bound that isn't either: a unit's self-kernel is at least the sum of its
    squared weights, so most units need no more than that.
    """
    out = np.full(len(a), machine.bias)
    for part, code, w in by_length(letters, a, b):
        raw = table[code] @ w
        value = raw / np.sqrt(np.maximum((w * w * (code > 0)).sum(axis=1), 1e-12))
        near = np.flatnonzero(value + machine.bias > above) if above > -np.inf else np.arange(len(part))
        if len(near):
            value[near] = raw[near] / np.sqrt(self_kernel(code[near], w))
        out[part] = value + machine.bias
    return out


def _significant(pos: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Which words are in more toxic texts than chance gives them, each by the binomial tail of its own counts, at a false discovery rate of FALSE."""
    pairs, inv, many = np.unique(np.column_stack((pos, total)), axis=0, return_inverse=True, return_counts=True)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, total.max() + 1)))))
    tail = np.empty(len(pairs))
    for r, (x, n) in enumerate(pairs):
        i = np.arange(x, n + 1)
        tail[r] = np.exp(logs[n] - logs[i] - logs[n - i] + i * np.log(share) + (n - i) * np.log1p(-share)).sum()
    order = np.argsort(tail, kind="stable")
    rank = np.cumsum(many[order])
    fits = np.flatnonzero(tail[order] * len(pos) <= FALSE * rank)
    good = np.zeros(len(pairs), dtype=bool)
    good[order[: fits[-1] + 1 if len(fits) else 0]] = True
    return good[inv.ravel()]


def _landmarks(words: list[bytes]) -> list[bytes]:
    """At least TOXIC_MARKS of the words, the first one and then always the one least like those taken, until each is like one of them."""
    like = features(words, words[:1])[:, 0]
    marks = words[:1]
    while len(marks) < len(words) and (len(marks) < TOXIC_MARKS or like.min() < ALIKE):
        marks.append(words[int(np.argmin(like))])
        like = np.maximum(like, features(words, marks[-1:])[:, 0])
    return marks


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Machine | None:
    """Trains on whole texts with a label each; None if they don't tell, as with labels of one kind."""
    letters, a, b, text, sent = units(texts)
    if not len(a) or toxic.all() or not toxic.any():
        return None
    h = unit_hashes(letters, a, b)
    # A sentence is known by its units; copies of it count once, and as harmless if any of them is.
    begins = np.flatnonzero(np.concatenate(([True], sent[1:] != sent[:-1])))
    key = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(begins, np.diff(np.append(begins, len(h)))).astype(np.uint64) + np.uint64(1)), begins)
    bad = toxic[text[begins]]
    _, pick, inv = np.unique(key, return_index=True, return_inverse=True)
    harmless = np.zeros(len(pick), dtype=bool)
    np.logical_or.at(harmless, inv, ~bad)
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(h))))
    chosen = np.zeros(len(begins), dtype=bool)
    chosen[pick] = True
    label = np.zeros(len(begins), dtype=bool)
    label[pick] = ~harmless
    use = chosen[of] & (b - a >= ORDER)
    hs, us, ls, ts = h[use], np.flatnonzero(use), label[of[use]], text[use]
    u, at, inv = np.unique(hs, return_index=True, return_inverse=True)

    def spread(which: np.ndarray) -> np.ndarray:
        """In how many sentences, or documents if these are fewer, a unit is."""
        docs = np.unique(inv[which].astype(np.int64) * len(texts) + ts[which]) // len(texts)
        sentences = np.unique(inv[which].astype(np.int64) * (len(begins) + 1) + of[use][which]) // (len(begins) + 1)
        return np.minimum(np.bincount(docs, minlength=len(u)), np.bincount(sentences, minlength=len(u)))

    pos, neg = spread(ls), spread(~ls)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = ((pos + 0.5) / n1) / ((neg + 0.5) / n0)
    suspect = odds >= RATIO
    # Rare words of high odds can be chance, so each is judged by its own counts, however frequent other words are.
    witness = suspect & (pos >= LEAST) & _significant(pos, pos + neg, n1 / (n1 + n0))
    if not witness.any():
        return None
    first = us[at]

    def spelt(which: np.ndarray) -> list[bytes]:
        return [letters[a[i] : b[i]].tobytes() for i in first[which]]

    rng = np.random.default_rng(seed)
    bad_units = np.flatnonzero(witness)
    bad_units = bad_units[np.argsort(-pos[bad_units], kind="stable")]
    bad_words = spelt(bad_units)
    # A suspect may be an insult too rare to prove, so it isn't an example of either kind.
    plain = np.flatnonzero((neg > 0) & ~suspect)
    plain_words = spelt(plain)
    marks_bad = _landmarks(bad_words)
    # Plain landmarks are the units most like the toxic ones, and these with others by chance are the plain examples.
    near = features(plain_words, marks_bad).max(axis=1)
    order = np.argsort(-near, kind="stable")
    marks = marks_bad + [plain_words[i] for i in order[: max(PLAIN_MARKS, len(marks_bad))]]
    some = np.unique(np.concatenate((order[:NEAR_PLAIN], rng.choice(len(plain), min(len(plain), OTHER_PLAIN), replace=False))))
    plain_words = [plain_words[i] for i in some]
    # Toxic units also with a letter put in or doubled, as people write them to get by.
    varied = []
    for w in bad_words:
        for _ in range(8):
            i = int(rng.integers(1, len(w)))
            varied.append(w[:i] + bytes([int(rng.integers(97, 123))]) + w[i:])
            varied.append(w[:i] + w[i - 1 : i] + w[i:])
    y = np.concatenate((np.ones(len(bad_words) + len(varied)), -np.ones(len(plain_words))))
    kzz = features(marks, marks)
    value, vector = np.linalg.eigh((kzz + kzz.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    phi = features(bad_words + varied + plain_words, marks) @ root
    w, bias = _hinge(phi, y, rng)
    machine = Machine(marks, root @ w, bias, len(marks_bad))
    # The cut: where two in a thousand harmless documents would be lost, but not beyond half of what plain insults get.
    value = np.full(len(texts), -9.0)
    each = _by_distinct(machine, machine.table(), letters, a, b, h, -np.inf)
    np.maximum.at(value, text, each)
    calm = np.sort(value[~toxic])
    least = float(np.quantile(phi[: len(bad_words)] @ w + bias, 0.05))
    machine.cut = float(max(LOWEST, min(calm[int(0.998 * (len(calm) - 1))] + 0.02, 0.6 * least)))
    # How often harmless documents have units as bad as that, and the evidence that tells most labelled documents right.
    found = _hits(machine, each, letters, a, b, text, h)
    off = ~toxic[found.text]
    machine.usual, machine.vile = ([np.sort(found.value[side & (found.mark == k)]) for k in range(machine.toxic)] for side in (off, ~off))
    size = _distinct_units(text, h, len(texts))
    machine.calm, machine.ill = max(1, int(size[~toxic].sum())), max(1, int(size[toxic].sum()))
    proof = _evidence(machine, found, size)
    machine.enough = _parting(proof[toxic], proof[~toxic])
    return machine


def _parting(high: np.ndarray, low: np.ndarray) -> float:
    """The value above which the fewest of both are on the wrong side; the middle of the gap there, the highest of equals."""
    at = np.unique(np.concatenate((high, low)))
    wrong = np.searchsorted(np.sort(high), at, side="right") + len(low) - np.searchsorted(np.sort(low), at, side="right")
    i = len(at) - 1 - int(np.argmin(wrong[::-1]))
    return float(at[i] if i + 1 == len(at) else (at[i] + at[i + 1]) / 2)


def _hinge(phi: np.ndarray, y: np.ndarray, rng, rounds: int = 400, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support vector machine: squared hinge loss, classes of equal weight, by accelerated gradient descent."""
    x = np.column_stack((phi, np.ones(len(phi))))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    z, t = w.copy(), 1.0
    rate = 1 / (2 * (share * (x * x).sum(axis=1)).sum() + c)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        g = -2 * x.T @ (share * y * slack) + c * z
        new = z - rate * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def _by_distinct(machine: Machine, table: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, above: float) -> np.ndarray:
    """Each different unit is scored once."""
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    return score_units(machine, table, letters, a[at], b[at], above)[inv]


@dataclass
class Hits:
    """Units above the cut, different ones within a text: (text, value, the witness among the landmarks it is most like)."""

    text: np.ndarray
    value: np.ndarray
    mark: np.ndarray


def _hits(machine: Machine, value: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray, h: np.ndarray) -> Hits:
    i = np.flatnonzero(value > machine.cut)
    i = i[np.unique(np.column_stack((text[i].astype(np.uint64), h[i])), axis=0, return_index=True)[1]]
    _, at, inv = np.unique(h[i], return_index=True, return_inverse=True)
    words = [letters[a[k] : b[k]].tobytes() for k in i[at]]
    mark = features(words, machine.marks[: machine.toxic]).argmax(axis=1) if words else np.zeros(0, dtype=np.int64)
    return Hits(text[i], value[i], mark[inv])


def _distinct_units(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(np.unique(np.column_stack((text.astype(np.uint64), h)), axis=0)[:, 0].astype(np.int64), minlength=n)


def _evidence(machine: Machine, hits: Hits, size: np.ndarray) -> np.ndarray:
    """How much likelier each text's units above the cut are in a toxic text than in a harmless one, as the logarithm of the ratio of two Poisson laws."""
    out = np.zeros(len(size))
    if not len(hits.text):
        return out
    ratio = np.empty(len(hits.text))
    for k in range(machine.toxic):
        own = hits.mark == k
        usual, vile = ((len(v) - np.searchsorted(v, hits.value[own], side="left") + 0.5) / n for v, n in ((machine.usual[k], machine.calm), (machine.vile[k], machine.ill)))
        ratio[own] = np.log(vile / usual)
    more = sum(map(len, machine.vile)) / machine.ill - sum(map(len, machine.usual)) / machine.calm
    out = np.bincount(hits.text, weights=ratio, minlength=len(size)) - size * more
    out[np.bincount(hits.text, minlength=len(size)) == 0] = 0
    return out


def document_scores(machine: Machine, table: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
    """(the highest score of each text's sentences, exact if above the cut; the number of sentences above the cut, none in a text of too little evidence)."""
    letters, a, b, text, sent = units(texts)
    score, number = np.full(len(texts), -9.0), np.zeros(len(texts), dtype=np.int64)
    if not len(a):
        return score, number
    h = unit_hashes(letters, a, b)
    value = _by_distinct(machine, table, letters, a, b, h, machine.cut)
    np.maximum.at(score, text, value)
    proven = _evidence(machine, _hits(machine, value, letters, a, b, text, h), _distinct_units(text, h, len(texts))) > machine.enough
    hit = (value > machine.cut) & proven[text]
    if hit.any():
        pairs = np.unique(np.column_stack((text[hit], sent[hit])), axis=0)
        number = np.bincount(pairs[:, 0], minlength=len(texts))
    return score, number


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Machine | None:
    """A machine from at most ``sample`` labelled documents, chosen by a hash of the id.

    Labels without an id or value are left out, of contradicting ones the lowest counts; so do rows that repeat an id and
    text as often as they come. Null and empty texts have no units. Without labels of both kinds, as in an empty table,
    there is no machine. Extra columns are not read.
    """
    need(docs, text, doc_id)
    need(labels, doc_id, label)
    chosen = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), "id").toArrow().sort_by([("id", "ascending"), ("body", "ascending")])
    return fit(got.column("body"), got.column("y").to_numpy() == 1) if len(got) else None


def toxic_documents(docs: DataFrame, machine: Machine | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, n_toxic): the documents with a toxic sentence and more bad units than chance gives, the score of the worst and the number of such sentences.

    Null, empty and wordless texts are never toxic; nor is anything without a machine. Whole texts are read, long words in
    overlapping windows. Null ids are passed on, repeated rows give a row each; a score or evidence equal to its bound isn't
    toxic. An empty table gives an empty one; extra columns are not read.
    """
    need(docs, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n_toxic", T.LongType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = machine.table() if machine else None
        for whole in stream:
            for batch in slices(whole, "body", BATCH_BYTES, 5000) if machine else ():
                score, n = document_scores(machine, table, batch.column("body"))
                bad = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(bad)), pa.array(score[bad]), pa.array(n[bad].astype(np.int64))], names=["doc_id", "score", "n_toxic"])

    return rows.mapInArrow(run, schema)
