"""Secret scans: fixed patterns, and values in a credential's place that are dear to guess.

Guess cost: the least sum, over all ways to cut a value, of the log10 guesses of its parts. A part is a known word, a
date, a repeat, a walk over neighbouring keys or along the alphabet, or a single character by brute force. Words are
known by their rank: that in the corpus, from counts of the texts that have them, or that in a public vocabulary file,
whichever is better. A value after a credential's name is a secret if its cost reaches ``MIN_COST``, so that
``password: environment`` is none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.ranking import ranked
from segjobs.llm import base

# The base patterns, the fewest characters, and the order of kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_16 = re.compile(r"[0-9a-f]{16,}")  # the same matches as of [0-9a-f]+ with 16 characters or more
KINDS = ("assign", "access", "hex", "guess")

MIN_COST = 10.0
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|auth(?:orization)?|(?:api|access|private|client|signing)[_-]?key)"""
    r"""["'`]?[\x20\t]{0,3}(?:=>|:=|[:=])[\x20\t]{0,3}(?:bearer\x20)?["'`]?([^\s"'`<>]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: What every credential's name has a part of: in texts without it nothing is looked for.
CONTEXT_HINT = r"(?i)pass|pwd|secret|token|credential|auth|key"
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key")

# Frequent words of passwords, most frequent first; rows of keys; characters put for letters.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login secret abc123 changeme default test guest root user hello love "
    "sunshine princess football baseball shadow superman batman trustno freedom whatever ninja iloveyou flower hunter summer winter spring autumn "
    "monday friday january august october december example sample dummy placeholder your token key pass api access private public string value none null true false "
    "insert here todo fixme xxxx foobar foo bar baz company server database service system manager demo temp word phrase the and for with this that"
).split()
KEYS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
_LEET = str.maketrans("013457@$!", "oleastasi")
_DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)"
)
#: Words of the corpus and of the vocabulary that are known, by their ranks; longest word, repeat and walk that count as
#: one part.
MAX_WORDS = 20_000
#: A word of the corpus is in so many different texts, and in one of so many.
MIN_TEXTS, ONE_IN = 5, 100_000
LONGEST = 32


_PLACE = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row) if c != " "}
#: Guesses for where a walk begins and, for each step that leaves the direction of the one before, where it turns.
_STARTS, _TURNS = math.log10(47), math.log10(8)


def key_step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbour in its row or the next (each is set off by half a key), else None."""
    if a == b or a not in _PLACE or b not in _PLACE:
        return None
    (r, k), (s, m) = _PLACE[a], _PLACE[b]
    near = abs(r - s) <= 1 and abs(m + s / 2 - k - r / 2) <= 1
    return (s - r, m - k) if near else None


def letter_step(a: str, b: str) -> int | None:
    """1 or -1 for the next or last letter of the alphabet, else None."""
    return ord(b) - ord(a) if "a" <= a <= "z" and "a" <= b <= "z" and abs(ord(b) - ord(a)) == 1 else None


def parts_from(value: str, lower: str, plain: str, i: int, words: Mapping[str, int]) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of every part of a value that begins at i. lower, plain: the value in lower case, and with
    letters for characters that often stand for them."""
    n = len(value)
    yield i + 1, 1.0  # ten guesses a character
    for j in range(i + 3, min(n, i + LONGEST) + 1):
        exact, other = words.get(lower[i:j]), words.get(plain[i:j])
        cost = min(math.log10(exact + 1) if exact else math.inf, math.log10(other + 1) + 0.3 if other else math.inf)
        if cost < math.inf:
            yield j, cost + (0.3 if value[i:j] != lower[i:j] else 0.0)
    for m in (_DATE.match(value, i, e) for e in range(min(n, i + 10), i + 3, -1) if value[i].isdigit()):
        if m:
            yield m.end(), 2.1 if m.end() - i == 4 else 4.6
    for size in range(1, min(8, (n - i) // 2) + 1):
        unit, times = value[i : i + size], 1
        while times * size < LONGEST and value[i + times * size : i + (times + 1) * size] == unit:
            times += 1
            if times * size >= 3:
                rank = words.get(unit.lower())
                yield i + times * size, min(float(size), math.log10(rank + 1) + 0.3 if rank else math.inf) + math.log10(
                    times
                )
    for step_of in (key_step, letter_step):
        way, turns = None, 0
        for j in range(i + 1, min(n, i + LONGEST)):
            step = step_of(lower[j - 1], lower[j])
            if step is None:
                break
            turns += way is not None and step != way
            way = step
            if j - i >= 2:
                yield j + 1, _STARTS + math.log10(j - i + 1) + turns * _TURNS


def guess_cost(value: str, words: Mapping[str, int]) -> float:
    """log10 of the guesses for the cheapest cut of the value. Time grows in proportion to its length."""
    n = len(value)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(_LEET)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        for end, cost in parts_from(value, lower, plain, i, words):
            if best[i] + cost < best[end]:
                best[end] = best[i] + cost
    return best[n]


def vocabulary_words(path: str, most: int = MAX_WORDS) -> dict[str, int]:
    """Ranks of the words in a tokenizers file, by their ids: tokens of letters that begin or end a word."""
    from tokenizers import Tokenizer

    ranks: dict[str, int] = {}
    for token, _ in sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1]):
        word = token.removeprefix("Ġ").removesuffix("</w>").lower()
        if word != token.lower() and word.isalpha() and word.isascii() and len(word) > 2:
            ranks.setdefault(word, len(ranks) + 1)
    return {w: r for w, r in ranks.items() if r <= most}


def corpus_words(docs: DataFrame, most: int = MAX_WORDS, min_texts: int = MIN_TEXTS, one_in: int = ONE_IN) -> dict[
    str, int
]:
    """Ranks of the ``most`` words of letters alone that the most texts have, ties by the word.

    What stands in a credential's place is no evidence of a word, so it is cut out first; a text counts once, however
    often it has the word and however many copies it has; and a word is known if ``min_texts`` texts and one in
    ``one_in`` have it. So a secret that leaked often is not taken for a word, and repeated rows change nothing.

    Words are counted in tasks before the shuffle, and ranked over ranges of their counts, so that only the ``most``
    words themselves, a bounded number, come to the driver.
    """
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").withColumn(
        "key", F.xxhash64("text")
    )
    copies = keyed.groupBy("key").agg(F.count("*").alias("n"))
    n_texts = copies.count()
    repeated = base.small(base.stored(copies.where("n > 1").select("key")))
    once = keyed.join(repeated, "key", "left_anti").select("text")
    again = keyed.join(repeated, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("text")
    text = F.when(F.col("text").rlike(CONTEXT_HINT), F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")).otherwise(
        F.col("text")
    )
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![^\s\p{P}])\p{L}{3,32}(?![^\s\p{P}])"), 0))
    counts = once.unionByName(again).select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = counts.where((F.col("n") >= min_texts) & (F.col("n") * one_in >= n_texts))
    top = ranked(counts, F.desc("n"), F.asc("word")).where(F.col("rank") <= most)
    return {r["word"]: r["rank"] for r in top.select("word", "rank").collect()}


def known_words(docs: DataFrame | None = None, vocabulary: str | None = None, most: int = MAX_WORDS) -> dict[str, int]:
    """Each word's best rank among the frequent words of passwords, of the vocabulary and of the corpus."""
    out = {w: k for k, w in enumerate(WORDS, 1)}
    for more in (
        vocabulary_words(vocabulary, most) if vocabulary else {}, corpus_words(docs, most) if docs is not None else {}
    ):
        for word, rank in more.items():
            out[word] = min(rank, out.get(word, rank))
    return out


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out = []
    if any(x in low for x in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_16.finditer(text)]
    return sorted(out)


class Scanner:
    """spans(text): base spans, and those that the guess cost adds outside of them; code points, end exclusive."""

    def __init__(self, words: Mapping[str, int], min_cost: float = MIN_COST):
        self.min_cost = min_cost
        self.cost_of = lru_cache(maxsize=20_000)(lambda value: guess_cost(value, words))

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        if not text:
            return [], []
        low = text.encode().lower()
        found = base_spans(text, low)
        added = []
        if any(x in low for x in _HINTS):
            for m in CONTEXT.finditer(text):
                a, b = m.span(1)
                if not any(s <= a and b <= e for s, _, e in found) and self.cost_of(m[1]) >= self.min_cost:
                    added.append((a, 3, b))
        return found, added


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def scanned(docs: DataFrame, words: Mapping[str, int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans of each row's whole text; row by row.

    words: known_words(), by default those of docs without a vocabulary file. A null text is an empty one, without
    spans. Repeated rows are scanned alike and change no other row's spans; columns besides doc_id and text are not
    read. Spans are ``kind:start:end``, by start and then by kind, comma-joined.
    """
    # three times MAX_WORDS entries at most
    sent = docs.sparkSession.sparkContext.broadcast(dict(known_words(docs) if words is None else words))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
    types = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def rows(batches):
        scanner = Scanner(sent.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, added = scanner.spans(text)
                kinds = [k for _, k, _ in found]
                digest = hashlib.sha256(_joined(found).encode()).hexdigest()
                out.append((doc_id, *(kinds.count(k) for k in range(3)), len(added), digest, _joined(found + added)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names
                )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def masked(docs: DataFrame, words: Mapping[str, int] | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by the mask; overlapping spans share one. Null texts stay null, other
    columns and all rows as they are. words: as for scanned()."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(known_words(docs) if words is None else words))

    def rows(batches):
        scanner = Scanner(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                found, added = scanner.spans(text)
                if found or added:
                    parts, end = [], 0
                    for a, _, b in sorted(found + added):
                        if a >= end:
                            parts += [text[end:a], mask]
                        end = max(end, b)
                    texts[i] = "".join([*parts, text[end:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(rows, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents")
    words = known_words(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return scanned(docs, words).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.col("n_guess")
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}
#: No SQL: DuckDB has no dynamic programming over values; tests compare with all cuts of values and with re-made spans.
SQL: dict[str, str] = {}
