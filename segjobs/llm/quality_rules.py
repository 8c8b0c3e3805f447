"""Quality rules: counts over whole texts, and lines labelled content or boilerplate by a linear-chain CRF.

The rules fail a text of under 20 words, or one of whose words over 30 % lie in 8-word windows that occur twice or
more in it. Every line with a word is then labelled by Viterbi decoding, and a text whose share of words in content
lines is under ``MIN_CONTENT`` is not kept. The CRF is fitted on labelled documents, at most ``MAX_FIT`` of each
quality: lines of poor ones count as boilerplate unless a good one has them too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from segjobs.llm import base
from segjobs.llm.tokens import groups, segment_hashes

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
MIN_CONTENT = 0.5
MAX_FIT = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _table("#*$%&|<>")
_UPPER, _LETTER, _DIGIT, _SHOUT, _STOP = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table(
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
), _table("0123456789"), _table("!"), _table(".!?:;")
N_FEATURES = 17


def _sums(mask: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=upto[1:])
    return upto[end] - upto[begin]


def measured(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of each text, and of all its lines with a word their features, 0 or 1.

    Keys: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines by text; line_words, features,
    line_hash by line, in order. Texts are laid out in one buffer, each closed by a line break.
    """
    raw = b"".join(x for t in texts for x in ((t or "").encode(), b"\n"))
    data = np.frombuffer(raw, np.uint8)
    length = np.array([len((t or "").encode()) + 1 for t in texts], np.int64)
    end = np.cumsum(length)
    begin = end - length
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    from_, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = segment_hashes(data, from_, to)
    char = (data & 0xC0) != 0x80
    out = {
        "n_words": _sums(first, begin, end),
        "word_chars": _sums(solid & char, begin, end),
        "n_symbols": _sums(_SYMBOL[data], begin, end),
    }

    text_of = np.searchsorted(end, from_, "right").astype(np.uint64)
    out["n_repeat_words"] = np.zeros(len(texts), np.int64)
    runs = base.run_hashes(words, WINDOW)
    if len(runs):
        inside = np.flatnonzero(text_of[: len(runs)] == text_of[WINDOW - 1 :])
        own = base.mixed(runs[inside] + text_of[inside] * np.uint64(0x9E3779B97F4A7C15))
        _, which, times = np.unique(own, return_inverse=True, return_counts=True)
        again = inside[times[which] > 1]
        steps = np.zeros(len(words) + WINDOW + 1, np.int64)
        steps[again] += 1
        np.subtract.at(steps, again + WINDOW, 1)
        covered = np.cumsum(steps)[: len(words)] > 0
        out["n_repeat_words"] = np.bincount(text_of[covered].astype(np.int64), minlength=len(texts))

    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    n = _sums(first, start, stop)
    full = n > 0
    start, stop, n = start[full], stop[full], n[full]
    line_text = np.searchsorted(end, start, "right")
    hashes = segment_hashes(data, start, stop) if len(start) else np.empty(0, np.uint64)
    own = base.mixed(hashes + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, earliest, which = np.unique(own, return_index=True, return_inverse=True)
    repeated = earliest[which] < np.arange(len(own)) if len(own) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_text[repeated], minlength=len(texts))
    out["n_lines"] = np.bincount(line_text, minlength=len(texts))
    out["line_words"], out["line_hash"] = n, hashes

    line_of = np.searchsorted(stop, from_, "right").astype(np.uint64)
    kinds = np.unique(base.mixed(words + line_of * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(line_of[kinds].astype(np.int64), minlength=len(n))
    size = np.maximum(stop - start, 1)
    letters = np.maximum(_sums(_LETTER[data], start, stop), 1)
    symbols, upper, shouts, digits = (_sums(x[data], start, stop) for x in (_SYMBOL, _UPPER, _SHOUT, _DIGIT))
    ends = to[np.searchsorted(from_, stop, "left") - 1] - 1 if len(stop) else np.empty(0, np.int64)
    letters_a_word = _sums(solid, start, stop) / n
    f = (
        np.ones(len(n), bool), n <= 2, (n > 2) & (n <= 5), n > 15,
        symbols > 0, symbols > 0.3 * n, symbols > 0.8 * n, upper > 0.5 * letters, shouts > 0.3 * n, digits > 0.3 * size,
        _STOP[data[ends]] if len(ends) else np.zeros(
            0, bool
        ), repeated, distinct < 0.6 * n, letters_a_word < 3, letters_a_word > 14,
        (n > 5) & (symbols == 0) & (upper <= 0.2 * letters), distinct < 0.3 * n,
    )
    out["features"] = np.stack(f, axis=1).astype(np.uint8).reshape(len(n), N_FEATURES)
    return out


class LineLabels:
    """A linear-chain CRF over lines with two labels, 0 content and 1 boilerplate."""

    def __init__(self, state: np.ndarray | None = None, change: np.ndarray | None = None):
        self.state = np.zeros((N_FEATURES, 2)) if state is None else state
        self.change = np.zeros((2, 2)) if change is None else change

    @staticmethod
    def _steps(n_lines: np.ndarray):
        """Texts ordered by their number of lines; how many still have a line at each step."""
        begin = np.cumsum(n_lines) - n_lines
        order = np.argsort(-n_lines, kind="stable")
        order = order[n_lines[order] > 0]
        many = np.searchsorted(-n_lines[order], -np.arange(1, int(n_lines.max(initial=0)) + 1), "right")
        return begin[order], many

    def fit(
        self,
        features: np.ndarray,
        n_lines: np.ndarray,
        labels: np.ndarray,
        rounds: int = 80,
        rate: float = 0.3,
        shrink: float = 1e-3,
    ) -> LineLabels:
        """Maximise the regularised conditional likelihood by gradient steps of adapted size."""
        x, y = features.astype(np.float64), labels.astype(np.int64)
        if not len(y):
            return self
        begin, many = self._steps(n_lines)
        want_state = np.stack([x[y == k].sum(axis=0) for k in (0, 1)], axis=1)
        inner = np.ones(len(y), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)
        want_change = np.zeros((2, 2))
        np.add.at(want_change, (y[at - 1], y[at]), 1)
        speed_s, speed_c = np.zeros_like(self.state), np.zeros_like(self.change)
        for _ in range(rounds):
            score = x @ self.state
            ahead, back = np.empty_like(score), np.zeros_like(score)
            for t, m in enumerate(many):
                i = begin[:m] + t
                ahead[i] = score[i] if t == 0 else score[i] + np.logaddexp(
                    ahead[i - 1, :1] + self.change[0], ahead[i - 1, 1:] + self.change[1]
                )
            for t in range(len(many) - 1, 0, -1):
                i = begin[: many[t]] + t
                v = score[i] + back[i]
                back[i - 1] = np.logaddexp(v[:, :1] + self.change[:, 0], v[:, 1:] + self.change[:, 1])
            whole = np.logaddexp(ahead[:, 0] + back[:, 0], ahead[:, 1] + back[:, 1])
            chance = np.exp(ahead + back - whole[:, None])
            pair = np.exp(
                ahead[at - 1][:, :, None] + self.change + (score[at] + back[at])[:, None, :] - whole[at][:, None, None]
            )
            slope_s = (want_state - x.T @ chance) / len(y) - shrink * self.state
            slope_c = (want_change - pair.sum(axis=0)) / len(y) - shrink * self.change
            speed_s, speed_c = 0.95 * speed_s + 0.05 * slope_s**2, 0.95 * speed_c + 0.05 * slope_c**2
            self.state = self.state + rate * slope_s / (np.sqrt(speed_s) + 1e-6) * 0.3
            self.change = self.change + rate * slope_c / (np.sqrt(speed_c) + 1e-6) * 0.3
        return self

    def best(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The likeliest labels of all lines, by Viterbi decoding of all texts side by side."""
        score = features @ self.state
        came = np.zeros((len(score), 2), np.int8)
        begin, many = self._steps(n_lines)
        for t, m in enumerate(many[1:], 1):
            i = begin[:m] + t
            ways = score[i - 1][:, :, None] + self.change
            came[i] = ways[:, 1] > ways[:, 0]
            score[i] += ways.max(axis=1)
        label = np.zeros(len(score), np.int8)
        for t in range(len(many) - 1, -1, -1):
            i = begin[: many[t]] + t
            label[i] = score[i, 1] > score[i, 0]
            if t + 1 < len(many):
                on = begin[: many[t + 1]] + t
                label[on] = came[on + 1, label[on + 1]]
        return label


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> LineLabels:
    """A CRF from at most ``max_fit`` documents of each quality, chosen by a hash of their ids.

    Without labelled documents all weights are 0, and every line counts as content.
    """
    some = None
    for quality in (0, 1):
        of = labels.where(F.col("quality") == quality).select(
            F.col("doc_id").alias("labelled_id"), "quality"
        ).dropna().distinct()
        of = of.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_fit)
        some = of if some is None else some.unionByName(of)

    def rows(batches):
        for batch in batches:
            doc_ids, texts, quality = (batch.column(k).to_pylist() for k in range(3))
            for i, j in groups(texts):
                m = measured(texts[i:j])
                ends = np.cumsum(m["n_lines"])
                pieces = [slice(a, b) for a, b in zip(ends - m["n_lines"], ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids[i:j], pa.int64()),
                        "quality": pa.array(quality[i:j], pa.int32()),
                        "features": [m["features"][p].tobytes() for p in pieces],
                        "hashes": [m["line_hash"][p].tobytes() for p in pieces],
                    }
                )

    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).select(
        "doc_id", "text", "quality"
    ).mapInArrow(rows, "doc_id bigint, quality int, features binary, hashes binary")
    # at most 2 * max_fit documents
    sample = sorted(found.toLocalIterator(), key=lambda r: (r["doc_id"], r["quality"], r["hashes"]))
    good = {h for r in sample if r["quality"] == 1 for h in np.frombuffer(r["hashes"], np.uint64).tolist()}
    features = [np.frombuffer(r["features"], np.uint8).reshape(-1, N_FEATURES) for r in sample]
    marks = [
        np.array([r["quality"] == 0 and h not in good for h in np.frombuffer(r["hashes"], np.uint64).tolist()], bool)
        for r in sample
    ]
    if not sample:
        return LineLabels()
    return LineLabels().fit(np.concatenate(features), np.array([len(f) for f in features]), np.concatenate(marks))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rated(docs: DataFrame, model: LineLabels) -> DataFrame:
    """docs with the counts, n_content_words, base_failed and kept. Row by row; nothing is shuffled.

    docs: has text; all its columns stay, except that columns named as the new ones are replaced. A null or empty
    text has no word, fails and is not kept. Repeated rows are rated alike. Very long texts are rated whole.
    """
    state, change = model.state, model.change
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words")
    docs = docs.drop(*new, "base_failed", "kept")

    def rows(batches):
        crf = LineLabels(state, change)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for i, j in groups(texts):
                m = measured(texts[i:j])
                content = np.where(crf.best(m["features"], m["n_lines"]) == 0, m["line_words"], 0)
                upto = np.concatenate([[0], np.cumsum(content)])
                ends = np.cumsum(m["n_lines"])
                counts = {k: m[k] for k in COLUMNS} | {"n_content_words": upto[ends] - upto[ends - m["n_lines"]]}
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
                kept = ~failed & (counts["n_content_words"] >= MIN_CONTENT * m["n_words"])
                part = batch.slice(i, j - i)
                arrays = [
                    *part.columns, *(pa.array(counts[k], pa.int64()) for k in new), pa.array(failed), pa.array(kept)
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, *new, "base_failed", "kept"])

    added = [
        *(StructField(k, LongType()) for k in new),
        StructField("base_failed", BooleanType()),
        StructField("kept", BooleanType()),
    ]
    return docs.mapInArrow(rows, StructType([*docs.schema.fields, *added]))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rated(docs, fit(docs, base.table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_content_words",
    )


QUERIES = {"op8_quality_rules": op8_quality_rules}
#: No SQL: DuckDB has no CRF; tests compare the counts with brute force and the labels with all label sequences.
SQL: dict[str, str] = {}
