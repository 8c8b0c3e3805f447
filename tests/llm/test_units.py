import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from segjobs.llm import minhash, packing, quality_rules, resampling, secrets, token_ids
from segjobs.llm.tokens import UnitEncoder

ODD = [
    "",
    "  a  b ",
    "a\t b",
    "a \tb\n\n c",
    "a\t \tb",
    "don't it's a'b  'll",
    "x y  　z",
    "<|endoftext|> hi <|startoftext|>",
    "é ́a",
    "A\nB.\nC. d",
    "...",
    "a.\n b",
    "1234 12a3 a1.",
    "\n",
    "a\n",
    "\x1c a\x85b",
    "ΣΑΣ ΟΔΟΣ.",
    '"q" (a) b?!',
    "a\r\nb",
    "İstanbul ǅ ﬁ",
    "a≠b",
    "x\x00y",
    "trail ",
]
FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ENCODERS = {
    f: (UnitEncoder(public_tokenizers.path(f), spaces), Tokenizer.from_file(public_tokenizers.path(f)))
    for f, spaces in FILES
}


def check_encoding(texts):
    for mine, library in ENCODERS.values():
        flat, size = mine.encode(texts)
        ends = np.cumsum(size)
        for text, a, b in zip(texts, ends - size, ends, strict=True):
            assert flat[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoding_of_odd_texts():
    check_encoding([*ODD, None, "x" * 5000, "Ab.Cd,ef " * 500])


CONTROL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from([*CONTROL, " ", "\n", ".", "word", " Two,", "é", "<|", "|>"]), max_size=8).map(
            "".join
        ),
        max_size=5,
    )
)
def test_control_strings_are_what_the_library_makes_of_them(texts):
    check_encoding([*texts, CONTROL[0], CONTROL[0] * 3, "plain text between", f"a {CONTROL[0]} b.\n{CONTROL[1]}"])


def test_control_strings_as_text():
    for f, spaces in FILES:
        path = public_tokenizers.path(f)
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        text = "hello <|endoftext|> world<|startoftext|>"
        flat, size = UnitEncoder(path, spaces, control_as_text=True).encode([text, "x"])
        assert flat[: size[0]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file, spaces", FILES)
def test_units_met_again_are_not_learned_again(file, spaces):
    path = public_tokenizers.path(file)
    library, mine, learned = Tokenizer.from_file(path), UnitEncoder(path, spaces, keep=100), []
    learn = mine._learn
    mine._learn = lambda units, hashes: (learned.extend(units), learn(units, hashes))
    letters = "abcdefghij"
    for k in range(40):
        new = " ".join(f"w{letters[k % 10]}{letters[k // 10]}{x}q{y}" for x in letters[:4] for y in letters[:4])
        text = f"some words that come often. {new} and often, come what may"
        flat, _ = mine.encode([text])
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids
        assert mine.n < 150
    assert sum(u.strip() == "often" for u in learned) == 1
    assert len(learned) < 40 * 16 + 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é'.,!\n\t 1|#　 \x1cß—“s") | st.characters(codec="utf-8")), max_size=4))
def test_encoding_equals_the_library(texts):
    check_encoding(texts)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=600),
    st.sampled_from([7, 64, 1024]),
)
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    words, places, escapes = token_ids.coded(ids, block)
    assert (token_ids.decoded(words, escapes) == ids).all()
    for k in range(len(places)):  # any block by itself
        some = words[places[k] : places[k + 1] if k + 1 < len(places) else None]
        mine = ids[k * block : (k + 1) * block]
        assert (token_ids.decoded(some, mine[mine >= 2**60]) == mine).all()


def test_simple8b_is_dense():
    assert len(token_ids.coded(np.zeros(240, np.uint64))[0]) == 1
    assert len(token_ids.coded(np.ones(120, np.uint64))[0]) == 2


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([5, 16, 100]), st.lists(st.integers(1, 100), max_size=120))
def test_packing_plan(capacity, lengths):
    counts = Counter(min(x, capacity) for x in lengths)
    bins, placed = defaultdict(list), Counter()
    for length, rank, n, per, first, offset in packing.plan(dict(counts), capacity):
        assert rank == placed[length]
        placed[length] += n
        for k in range(n):
            bins[first + k // per].append((offset + length * (k % per), length))
    assert placed == counts and sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2
    # Not worse than first fit.
    rest = []
    for x in sorted(counts.elements(), reverse=True):
        k = next((k for k, r in enumerate(rest) if r >= x), None)
        if k is None:
            rest.append(capacity - x)
        else:
            rest[k] -= x
    assert len(bins) <= len(rest) + max(1, len(rest) // 20)


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.none() | st.lists(
            st.sampled_from(["a", "b", "é", " ", " ", "\n", "\t", "#", "a b c d e f g h i\n", "\x0b", "\x85"]),
            max_size=60,
        ).map("".join),
        max_size=4,
    )
)
def test_rule_counts_equal_brute_force(texts):
    m = quality_rules.measured(texts)
    for k, text in enumerate(texts):
        assert tuple(int(m[c][k]) for c in quality_rules.COLUMNS) == brute_rules(text)


def test_viterbi_finds_the_best_of_all_sequences():
    random = np.random.default_rng(5)
    for _ in range(20):
        n_lines = random.integers(0, 7, 4)
        features = random.integers(0, 2, (int(n_lines.sum()), quality_rules.N_FEATURES)).astype(np.uint8)
        crf = quality_rules.LineLabels(random.normal(size=(quality_rules.N_FEATURES, 2)), random.normal(size=(2, 2)))
        got, at = crf.best(features, n_lines), 0
        for n in n_lines.tolist():
            score = features[at : at + n] @ crf.state
            value = lambda way: sum(score[k, y] for k, y in enumerate(way)) + sum(  # noqa: B023, E731
                crf.change[a, b] for a, b in itertools.pairwise(way)
            )
            assert value(got[at : at + n].tolist()) == pytest.approx(
                max(map(value, itertools.product((0, 1), repeat=n)))
            )
            at += n


def test_crf_fit_separates():
    random = np.random.default_rng(6)
    labels = random.integers(0, 2, 400)
    features = np.zeros((400, quality_rules.N_FEATURES), np.uint8)
    features[:, 0], features[:, 3] = 1, labels
    crf = quality_rules.LineLabels().fit(features, np.full(40, 10), labels)
    assert (crf.best(features, np.full(40, 10)) == labels).mean() > 0.97
    assert (quality_rules.LineLabels().best(features, np.full(40, 10)) == 0).all()


def brute_base(text):
    out = [
        (m.start(), 0, m.end())
        for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            text,
            re.I | re.A,
        )
        if len(m[2]) >= 12
    ]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            [
                "token",
                "Api_Key",
                "PASSWORD",
                "secret",
                "=",
                ":",
                " ",
                '"',
                "'",
                "abcdef0123456789",
                "AKIA",
                "ABCDEFGHIJKLMNOP",
                "ſecret",
                "Kelvin",
                "xyz",
                "é",
                "\n",
                "0",
                "f",
            ]
        ),
        max_size=25,
    ).map("".join)
)
def test_base_spans_equal_brute_force(text):
    found, added = SCANNER.spans(text)
    assert found == brute_base(text)
    assert all(text[a:b] and k == 3 for a, k, b in added)


def part_cost(value, i, j, words):
    """The cost of value[i:j] as one part, each kind by itself."""
    part, low, n = value[i:j], value[i:j].lower(), j - i
    plain = low.translate(str.maketrans("013457@$!", "oleastasi"))
    costs = [1.0] if n == 1 else []
    case = 0.3 if part != low else 0.0
    if 3 <= n <= 32:
        costs += [np.log10(words[w] + 1) + case + more for w, more in ((low, 0.0), (plain, 0.3)) if w in words]
    if n >= 4 and re.fullmatch(secrets._DATE, part):
        costs.append(2.1 if n == 4 else 4.6)
    for size in range(1, min(8, n // 2) + 1):
        if 3 <= n < 32 + size and n % size == 0 and part == part[:size] * (n // size):
            rank = words.get(low[:size])
            costs.append(min(size, np.log10(rank + 1) + 0.3 if rank else np.inf) + np.log10(n // size))
    for step_of in (secrets.key_step, secrets.letter_step):
        steps = [step_of(a, b) for a, b in itertools.pairwise(low)]
        if 3 <= n <= 32 and None not in steps:
            costs.append(np.log10(47 * n) + np.log10(8) * sum(a != b for a, b in itertools.pairwise(steps)))
    return min(costs, default=np.inf)


def brute_cost(value, words):
    """The least sum over every one of the 2 ** (n - 1) cuts."""
    n, best = len(value), 0.0 if not value else np.inf
    for marks in itertools.product([False, True], repeat=max(0, n - 1)):
        at = [0, *(k + 1 for k, m in enumerate(marks) if m), n]
        best = min(best, sum(part_cost(value, a, b, words) for a, b in itertools.pairwise(at)) if value else 0.0)
    return best


RANKS = {w: k for k, w in enumerate(secrets.WORDS, 1)}
SCANNER = secrets.Scanner(RANKS)


@settings(max_examples=120, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            [
                "a",
                "b",
                "ab",
                "qwe",
                "rf",
                "tgb",
                "Pass",
                "foo",
                "B4r",
                "$",
                "2024",
                "-01-",
                "31",
                "monday",
                "7",
                "é",
                "cde",
            ]
        ),
        max_size=5,
    ).map("".join).filter(lambda x: len(x) <= 11)
)
def test_guess_cost_is_the_least_over_all_cuts(value):
    assert secrets.guess_cost(value, RANKS) == pytest.approx(brute_cost(value, RANKS))


def test_guess_costs():
    words = secrets.known_words(vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    scanner = secrets.Scanner(words)
    weak = (
        "password123456",
        "changeme",
        "aaaaaaaaaaaaaaaa",
        "qwertyuiop",
        "2024-01-31",
        "Monday2024",
        "P4ssw0rd",
        "abcabcabcabc",
        "environment",
        "documentation",
        "correcthorse",
        "Understanding!",
        "zaqxswcde",
        "qazwsxedc",
        "xabcdefgh",
    )
    for value in weak:
        assert secrets.guess_cost(value, words) < secrets.MIN_COST, value
    for strong in ("x9Kq2vPz7LmT", "hG7$kd02Vb!pQ", "Zr0vQmWxTbKd", "correct-horse-battery-staple-73"):
        assert secrets.guess_cost(strong, words) >= secrets.MIN_COST, strong
    found, added = scanner.spans("passphrase: hG7$kd02Vb!pQ and pwd = changeme")
    assert not found and [(a, b) for a, _, b in added] == [(12, 25)]
    assert scanner.spans(None) == ([], []) == scanner.spans("")
    assert len(scanner.spans("x" * 300_000 + " token=" + "xy1" * 50_000)[0]) == 1
    assert len(words) > 10_000 and max(words.values()) <= secrets.MAX_WORDS


def brute_sets(text, words):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {
        tuple(w)
    } if w else set()


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.none() | st.text(st.sampled_from("aAbB é\n\t"), max_size=40), min_size=1, max_size=5),
    st.sampled_from([1, 3, 5]),
)
def test_shingle_sets_have_the_right_sizes(texts, words):
    sets = minhash.shingle_sets(texts, words)
    exact = [brute_sets(t, words) for t in texts]
    assert [len(s) for s in sets] == [len(e) for e in exact]
    for (a, x), (b, y) in itertools.combinations(zip(sets, exact, strict=True), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_joining_links_exactly_what_is_similar():
    random = np.random.default_rng(8)
    base = random.integers(0, 2**63, 100, dtype=np.uint64)
    members = []
    for k in range(60):
        mine = base.copy()
        mine[random.choice(100, random.integers(0, 25), replace=False)] = random.integers(0, 2**63, dtype=np.uint64)
        members.append((0, k, k, np.unique(mine)))
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(members, 2):
        common = len(np.intersect1d(a[3], b[3]))
        if 100 * common >= 85 * (len(a[3]) + len(b[3]) - common):
            root[find(a[1])] = find(b[1])
    wanted = [find(k) for k in range(60)]
    root = list(range(60))
    for a, b in minhash.joining(members, (85, 100)):
        root[find(a)] = find(b)
    got = [find(k) for k in range(60)]
    assert len(set(zip(got, wanted, strict=True))) == len(set(got)) == len(set(wanted))


def test_grams_equal_brute_force():
    texts = ["A b a b", None, "", "x", "é  Z\nz"]
    of, bucket = resampling.grams(texts, 1 << 20)
    sizes = [0 if not t else 2 * len(t.split()) - 1 for t in texts]
    assert np.bincount(of, minlength=5).tolist() == sizes
    first = bucket[of == 0]
    assert Counter(Counter(first.tolist()).values()) == Counter([2, 2, 2, 1])  # a, b, "a b" twice, "b a" once
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")
