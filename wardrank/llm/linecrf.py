"""Quality rules: line labelling by a linear-chain conditional random field.

The lines of a text form a sequence; each is marked content or boilerplate by
Viterbi decoding of a CRF with 14 binary line features and label transitions.
A document is kept if no base rule fails and the words in content lines make
up at least ``min_share`` of its words.

The CRF is trained here, with numpy, by forward-backward gradients on a
bounded sample of labelled documents (``max_docs`` per label, those with the
lowest hash of the id among documents of at most ``max_lines`` lines); a
document's quality label stands in for the labels of its lines.  Decoding
covers whole texts.

Defined cases: null and empty texts have no words and fail the base rule;
lines without a word are skipped by the sequence; without labels of both
kinds every line is content; equal paths prefer content; labels that are null
or have no document are ignored; repeated documents are judged alike; input
columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_arrow

#: Fixed value: characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
FEATURES = ("at most two words", "thirty words or more", "a symbol", "symbols over 2 %", "symbols over 8 %",
            "no lower-case letter", "!! or ??", "two bars or more", "equal to an earlier line", "few distinct words",
            "ends a sentence", "digits over 10 %", "address or markup", "equal to the line before")
BOILERPLATE, CONTENT = 0, 1


def line_features(line: bytes, seen: set[bytes], before: bytes | None) -> int:
    """The features of one line as bits."""
    words = line.split()
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    digits = size - len(line.translate(None, b"0123456789"))
    marks = (n <= 2, n >= 30, symbols > 0, 50 * symbols > size, 12.5 * symbols > size,
             line.upper() == line and line.lower() != line, b"!!" in line or b"??" in line, line.count(b"|") >= 2,
             line in seen, n >= 8 and 2 * len(set(words)) < n, line.rstrip()[-1:] in b".!?", 10 * digits > size,
             b"http" in line or b"www." in line or b"@" in line or b"<" in line, line == before)
    return sum(1 << i for i, m in enumerate(marks) if m)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64)
    mixed = np.zeros(n, np.uint64)
    spread = (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for j in range(width):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + spread[j:j + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal sums
        return 0
    span = 1
    while span < width:  # exact: the rank of each window of twice the length
        step = min(span, width - span)
        rank = np.unique(rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        span += step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def lines_of(text: str | None) -> tuple[list[int], list[int], int]:
    """Features and words of each line with a word, and the number of such
    lines that equal an earlier line."""
    marks, words, repeats = [], [], 0
    seen: set[bytes] = set()
    before = None
    for line in text.encode("utf-8", "surrogatepass").split(b"\n") if text else []:
        if n := len(line.split()):
            marks.append(line_features(line, seen, before))
            words.append(n)
            repeats += line in seen
            seen.add(line)
            before = line
    return marks, words, repeats


@dataclass(frozen=True)
class LineCrf:
    emission: np.ndarray  # (2 ** features, 2): score of each label per feature bits
    transition: np.ndarray  # (2, 2): from the label before

    def decode(self, marks: list[int]) -> list[int]:
        """The best label sequence (Viterbi); content wins ties."""
        if not marks:
            return []
        (bb, bc), (cb, cc) = self.transition.tolist()
        scores = self.emission[marks].tolist()
        b, c = scores[0]
        back = []
        for sb, sc in scores[1:]:
            back.append((b + bb > c + cb, b + bc > c + cc))
            b, c = max(b + bb, c + cb) + sb, max(b + bc, c + cc) + sc
        label = BOILERPLATE if b > c else CONTENT
        path = [label]
        for from_b in reversed(back):
            label = BOILERPLATE if from_b[label] else CONTENT
            path.append(label)
        return path[::-1]


def _model(weights: np.ndarray, transition: np.ndarray) -> LineCrf:
    bits = (np.arange(1 << len(FEATURES))[:, None] >> np.arange(len(FEATURES))) & 1
    return LineCrf(np.hstack([bits, np.ones((len(bits), 1), int)]) @ weights, transition)


def fit_crf(sequences: list[np.ndarray], labels: list[int], steps: int = 100, rate: float = 0.1,
            l2: float = 0.01) -> LineCrf:
    """Maximise the mean conditional log-likelihood by Adam; sequences
    of similar length advance through forward and backward together, padded to
    the longest of them (less than twice their own length)."""
    k = len(FEATURES)
    weights, transition = np.zeros((k + 1, 2)), np.zeros((2, 2))
    sequences, labels = zip(*[(s, y) for s, y in zip(sequences, labels) if len(s)] or [((), 0)])
    if len(set(labels)) < 2:
        weights[-1, CONTENT] = 1.0
        return _model(weights, transition)
    label_of = np.array(labels)
    weight = (len(labels) / 2 / np.bincount(label_of))[label_of] / len(labels)  # both labels count alike
    alike: dict[int, list[int]] = {}
    for i, q in enumerate(sequences):
        alike.setdefault(len(q).bit_length(), []).append(i)
    batches = []
    for at in alike.values():
        size = np.array([len(sequences[i]) for i in at])
        marks = np.zeros((len(at), size.max()), np.int16)
        for row, i in enumerate(at):
            marks[row, :size[row]] = sequences[i]
        batches.append((marks, np.arange(size.max()) < size[:, None], np.eye(2)[label_of[at]],
                        weight[at] / size))  # every document counts once, whatever its length
    bits = np.hstack([(np.arange(1 << k)[:, None] >> np.arange(k)) & 1, np.ones((1 << k, 1), int)])
    m, v = np.zeros(2 * (k + 1) + 4), np.zeros(2 * (k + 1) + 4)
    for t in range(1, steps + 1):
        table, off_sum, g_t = bits @ weights, np.zeros((1 << k, 2)), np.zeros((2, 2))
        for marks, real, y, per in batches:
            longest = marks.shape[1]
            s = table[marks] * real[..., None]
            alpha, beta = np.zeros(s.shape), np.zeros(s.shape)
            alpha[:, 0] = s[:, 0]
            for i in range(1, longest):
                alpha[:, i] = np.where(real[:, i, None], np.logaddexp.reduce(alpha[:, i - 1, :, None] + transition, axis=1) + s[:, i], alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                beta[:, i] = np.where(real[:, i + 1, None], np.logaddexp.reduce(transition + (s[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2), 0)
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
            off = (y[:, None, :] * real[..., None] - p) * per[:, None, None]
            for c in range(2):
                off_sum[:, c] += np.bincount(marks.ravel(), weights=off[..., c].ravel(), minlength=1 << k)
            for i in range(1, longest):
                q = np.exp(alpha[:, i - 1, :, None] + transition + (s[:, i] + beta[:, i])[:, None, :] - total[:, None, None])
                g_t += ((y[:, :, None] * y[:, None, :] - q) * (per * real[:, i])[:, None, None]).sum(0)
        g_w = bits.T @ off_sum
        grad = np.concatenate([(g_w - l2 * weights).ravel(), (g_t - l2 * transition).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        weights, transition = weights + step[:-4].reshape(k + 1, 2), transition + step[-4:].reshape(2, 2)
    return _model(weights, transition)


def train_crf(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
              max_docs: int = 800) -> LineCrf:
    """Learn from at most ``max_docs`` labelled documents with lines a label."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull()).groupBy("_id").agg(F.min("_y").alias("_y")))
    with_lines = docs.where(F.col(text).cast("string").rlike(r"[^ \t\n\r\x0B\f]")).select(F.col(id_col).alias("_id"))
    known = known.join(with_lines, "_id", "left_semi")  # moves ids, no text
    chosen = None
    for y in (0, 1):
        rows = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        chosen = rows if chosen is None else chosen.unionByName(rows)

    def run(batches):
        for b in batches:
            marks = [lines_of(t)[0] for t in b["_text"].to_pylist()]
            ok = [i for i, m in enumerate(marks) if m]
            yield {"y": b["_y"].take(ok), "marks": [np.array(marks[i], "<i2").tobytes() for i in ok]}

    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))
              .join(F.broadcast(chosen), "_id").select("_y", "_text"))  # at most 2 * max_docs ids
    rows = sorted((r["y"], bytes(r["marks"])) for r in map_arrow(sample, fields("y int", "marks binary"), run).collect())
    return fit_crf([np.frombuffer(m, "<i2").astype(np.int64) for _, m in rows], [y for y, _ in rows])


ADDED = fields("n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long",
               "base_failed boolean", "content_share double", "kept boolean")


def judge(docs: DataFrame, model: LineCrf, text: str = "text", min_share: float = 0.5) -> DataFrame:
    """``docs`` with the base counts, ``content_share`` and ``kept``."""
    rest = docs.drop(*ADDED.names)

    def run(batches):
        for b in batches:
            rows = []
            for t in b[text].to_pylist():
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                words = raw.split()
                marks, sizes, repeats = lines_of(t)
                n_repeat = repeated_words(words)
                failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
                content = sum(n for n, y in zip(sizes, model.decode(marks)) if y == CONTENT)
                share = content / len(words) if words else 0.0
                chars = (len(t) - sum(map(t.count, _SPACES.decode()))) if t else 0
                rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), repeats, n_repeat,
                             failed, share, not failed and share >= min_share))
            yield b | dict(zip(ADDED.names, map(list, zip(*rows)), strict=True)) if rows else b | {n: [] for n in ADDED.names}

    return map_arrow(rest, T.StructType([*rest.schema.fields, *ADDED.fields]), run)
