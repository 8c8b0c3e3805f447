"""The text operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import hmac
import ipaddress
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from segjobs.llm import chat_format, decontamination, minhash, packing, quality_rules, queries, resampling, secrets, surrogates, token_ids, url_filter

random = np.random.default_rng(12)
VOCABULARY = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    words = r.choice(VOCABULARY, n).tolist()
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)).replace(". ", ".\n")


LEAK = prose(30, 99)
LONG = prose(9000, 1)
TEXTS = [
    (1, prose(80, 2)), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, prose(80, 2)), (
        7, prose(80, 2).replace(VOCABULARY[3], "zzz")
    ), (8, "one two"), (8, "one two"), (9, "One TWO"),
    (10, prose(40, 3) + "\n" + LEAK.upper() + "!!\n" + prose(40, 4)), (11, LEAK[:60]), (
        12, prose(60, 5) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(60, 6)
    ),
    (
        13,
        prose(
            60, 7
        ) + " mail Ann.Lee@corp.example.org or +1 (415) 555-2671, card 4111 1111 1111 1111, host 10.20.30.40, Mrs Jane Doe met Mr John Smith and Mrs Smith. ann.lee@corp.example.org",
    ),
    (14, " | ".join(VOCABULARY[:120])), (15, ("same line again and again here now\n") * 30), (None, prose(50, 8)), (
        16, "x" * 20000
    ), (17, prose(80, 9) + " " + prose(3, 10)), (18, prose(80, 9)),
    (19, "<|endoftext|>"), (20, "ends here<|endoftext|> and <|startoftext|>starts"),
]
LABELS = [(1, 1, 0), (5, 1, 0), (14, 0, 0), (17, 1, 0), (18, 1, 0), (12, 1, 1), (None, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 5, True) for i, t in TEXTS]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, n_words int, kept boolean",
    ).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    token_ids.write(docs, f"file://{tmp_path}/ids", path, partitions=3)
    rows = token_ids.read(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    wanted = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS]
    assert sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == sorted(
        (i or -1, ids) for i, ids in wanted
    )
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    token_ids.write(empty, f"file://{tmp_path}/none", path, partitions=2)
    assert token_ids.read(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=256).collect()
    wanted = Counter()
    for i, t in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            wanted[i, k, at, tuple(ids[at : at + 256])] += 1
    assert Counter(
        (r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows
    ) == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 256
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 256) + 2
    assert packing.pack(empty, path).count() == 0


def test_quality_rules(docs, labels, empty):
    model = quality_rules.fit(docs, labels)
    rows = {(r["doc_id"], r["text"]): r for r in quality_rules.rated(docs, model).collect()}
    assert rows[5, LONG]["kept"] and rows[5, LONG]["n_words"] == 9000
    for i in (2, 3, 4, 8, 15):
        assert not next(r for (k, _), r in rows.items() if k == i)["kept"]
    assert not next(r for (k, _), r in rows.items() if k == 14)["kept"]
    assert "node" in quality_rules.rated(docs, model).columns
    assert quality_rules.rated(empty, model).count() == 0
    assert (quality_rules.fit(docs, labels.where("false")).state == 0).all()


def test_secrets(docs, empty):
    rows = {r["doc_id"]: r for r in secrets.scanned(docs).collect()}
    assert rows[12]["n_assign"] == 1 and rows[12]["n_hex"] == 1 and rows[2]["spans"] == ""
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    assert "04dbebab" not in masked[12] and masked[1] == prose(80, 2) and masked[2] is None
    assert secrets.scanned(empty).count() == 0 and secrets.masked(empty).columns == empty.columns


def test_secrets_outside_the_base_patterns(spark):
    """Credential contexts that the base patterns lack; values of words, of the corpus or of a vocabulary, are none."""
    rows = [
        (1, "pwd: hG7$kd02Vb!pQ", ["hG7$kd02Vb!pQ"]), (
            2, "Authorization: Bearer kq8Zr0vQm-WxTbK", ["kq8Zr0vQm-WxTbK"]
        ), (3, "private_key => 'vR8!nd#2kQz0'", ["vR8!nd#2kQz0"]),
        (4, "password: environment", []), (5, "passphrase = ththandre", []), (
            6, "pwd=qazwsxedc client-key: 19991231", []
        ), (7, None, []), (8, "pwd: " + "Zk4$" + "x" * 9000, ["Zk4$" + "x" * 9000]),
    ]
    docs = spark.createDataFrame(
        [(i, t, "w") for i, t, _ in rows] + [(k, f"ththandre, ththandre {k}", "w") for k in range(20, 25)],
        "doc_id bigint, text string, spans string",
    )
    words = secrets.known_words(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert secrets.corpus_words(docs) == {"ththandre": 1} and secrets.corpus_words(
        docs, min_texts=6
    ) == {} and secrets.corpus_words(docs.where("false")) == {}
    got = {r["doc_id"]: r for r in secrets.scanned(docs, words).collect()}
    for i, text, wanted in rows:
        assert [
            text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s) if k == "guess"
        ] == wanted
        assert got[i]["n_guess"] == len(wanted)
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(docs, words).collect()}
    assert masked[1] == "pwd: [secret]" and masked[4] == rows[3][1] and masked[7] is None


def test_persons_in_all_their_forms(spark):
    """Mentions without a title, chains of titles, particles, hyphens, single given names and private networks."""
    texts = [
        "Mr John Smith wrote. John said hi. Later John Smith and Smith left; Smith's hat stayed, blacksmith too.", "Prof Dr Eva Braun and Herr Dr. Eva Braun-Keller met.", "Mr de la Cruz, Frau Anna von Berg and Mrs Anna came. Cruz sat.",
        "Monsieur Jean-Luc Picard, then Jean-Luc alone.", "from 10.1.2.3 to 192.168.7.9, 172.20.1.1 and 8.8.8.8", "John and Smith are nobody here.", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in surrogates.replaced(rows, "k").collect()}
    words = lambda t: re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t)
    first = re.fullmatch(
        r"Mr (\S+) (\S+) wrote\. (\S+) said hi\. Later (\S+) (\S+) and (\S+) left; (\S+)'s hat stayed, blacksmith too\.",
        got[0],
    ).groups()
    assert first[0] == first[2] == first[3] != "John" and first[1] == first[4] == first[5] == first[6] != "Smith"
    second = re.fullmatch(r"Prof Dr (\S+) (\S+) and Herr Dr\. (\S+) (\S+)-(\S+) met\.", got[1]).groups()
    assert second[0] == second[2] and not {"Eva", "Braun", "Keller"} & set(second)
    third = re.fullmatch(r"Mr de la (\S+), Frau (\S+) von (\S+) and Mrs (\S+) came\. (\S+) sat\.", got[2]).groups()
    assert third[0] == third[4] and third[1] == third[3] and not {"Cruz", "Anna", "Berg"} & set(third)
    fourth = re.fullmatch(r"Monsieur (\S+-\S+) (\S+), then (\S+-\S+) alone\.", got[3]).groups()
    assert fourth[0] == fourth[2] and not {"Jean-Luc", "Picard"} & set(words(got[3]))
    old, new = (re.findall(r"\d+(?:\.\d+){3}", t) for t in (texts[4], got[4]))
    for a, b in zip(old, new, strict=True):
        assert a != b and ipaddress.ip_address(a).is_private == ipaddress.ip_address(b).is_private
    assert got[5] == texts[5] and got[6] is None and got[7] == ""


def test_secrets_that_leaked_often_are_secrets(spark):
    """Repetition, in copies or in other texts, does not make a credential's value a word; nor does it change other
    rows."""
    schema = "doc_id bigint, text string"
    spans = lambda rows: {
        r["doc_id"]: r["spans"] for r in secrets.scanned(spark.createDataFrame(rows, schema)).collect()
    }
    text = "passphrase := xqzvkwjbtrm"
    assert spans([(1, text)]) == {1: "guess:14:25"}
    assert spans([(k, text) for k in range(30)]) == {k: "guess:14:25" for k in range(30)}
    assert set(spans([(k, f"note {k}\n{text}") for k in range(30)]).values()) == {
        f"guess:{14 + n}:{25 + n}" for n in (7, 8)
    }
    prose_rows = [(k, f"text {k} of gorbandel") for k in range(8)] + [(90, "pwd: gorbandel")]
    known = secrets.corpus_words(spark.createDataFrame(prose_rows, schema))
    assert known["gorbandel"] == secrets.corpus_words(spark.createDataFrame(prose_rows * 3, schema))["gorbandel"]
    assert spans(prose_rows)[90] == spans(prose_rows * 3)[90] == ""
    assert "gorbandel" not in secrets.corpus_words(
        spark.createDataFrame([(k, "the same gorbandel text") for k in range(50)], schema)
    )


def test_decontamination_without_its_filter(spark, docs):
    """Blocks and radius find the same leaks among all windows as among those that the shared shingles leave."""
    r = np.random.default_rng(21)
    passages = [r.choice(VOCABULARY[:60], n).tolist() for n in (12, 12, 12, 25, 25, 40, 5, 3)]
    texts = []
    for k in range(40):
        words = r.choice(VOCABULARY[:60], 50).tolist()
        own = list(passages[k % len(passages)])
        for _ in range(k % 4):
            own[int(r.integers(len(own)))] = "other"
        if k % 5 == 0:
            own = own[len(own) // 2 :] + own[: len(own) // 2]
        texts.append((k, " ".join([*words[:20], *own, *words[20:]])))
    texts += [(50, " ".join(passages[-1])), (51, None), (52, ""), (53, " ".join(passages[0][:11])), (54, texts[0][1])]
    own = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id bigint, text string")
    found = [
        sorted(decontamination._leaks(own, bench, every).select("doc_id", "item_id", "similarity_ppm").collect())
        for every in (False, True)
    ]
    assert found[0] == found[1] and len(found[0]) >= 10


def test_rare_shingles_weigh_enough(spark):
    """Shingles that many items have are not looked up in texts, as far as others weigh more than a similar window may
    lack."""
    common = "which of the following is the best answer to this"
    bench = spark.createDataFrame(
        [(k, f"{common} {prose(12, 100 + k)}") for k in range(30)], "item_id bigint, text string"
    )
    rows = decontamination.hashes_of(decontamination.items(bench)).collect()
    often = Counter(r["hash"] for r in rows)
    by_item = defaultdict(list)
    for r in rows:
        by_item[r["item"]].append(r)
    assert len(by_item) == 30
    for own in by_item.values():
        rare = [r for r in own if r["rare"]]
        assert 100 * sum(r["w"] for r in rare) > 20 * own[0]["item_weight"]
        assert max(often[r["hash"]] for r in rare) == 1


def test_resampling(docs, labels, empty):
    rows = resampling.resampled(docs, labels, keep=0.5).collect()
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    k = int(len(rows) * 0.5 + 0.5)
    assert all(r["kept"] == (r["gumbel_key"] >= keys[k - 1]) for r in rows)
    assert all(r["log_weight"] == 0 for r in rows if r["n_grams"] == 0)
    ratio = resampling.log_ratio(docs, labels)
    counts = {True: np.ones(resampling.BUCKETS), False: np.ones(resampling.BUCKETS)}
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    for i, t in TEXTS:
        _, bucket = resampling.grams([t], resampling.BUCKETS)
        np.add.at(counts[False], bucket, 1)
        if i in good:
            np.add.at(counts[True], bucket, 1)
    assert np.allclose(ratio, np.log(counts[True] / counts[True].sum()) - np.log(counts[False] / counts[False].sum()))
    assert resampling.resampled(empty, labels).count() == 0
    assert all(r["kept"] for r in resampling.resampled(docs, labels.where("false")).collect())


def test_kth_largest(spark):
    values = [int(x) for x in random.integers(-(2**62), 2**62, 50)] + [5, 5, -1, 0, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    for k in (1, 2, 20, 30, 55, 56):
        assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "v", 57) is None and resampling.kth_largest(df, "v", 0) is None


def exact_components(rows, words, num, den):
    sets = []
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append(
            (
                i,
                {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {
                    tuple(w)
                } if w else set(),
            )
        )
    least = {k: i for k, (i, _) in enumerate(sets)}
    changed = True
    pairs = [
        (a, b)
        for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2)
        if x and y and den * len(x & y) >= num * len(x | y)
    ]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return Counter((i, len(s), least[k], i == least[k]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("words", "num", "copies"), [(3, 85, 0), (5, 80, 120)])
def test_near_duplicates(spark, docs, empty, words, num, copies):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    if copies:  # a group of near copies that is compared in blocks, with links in chains
        r = np.random.default_rng(4)
        base = prose(90, 50).split(" ")
        for k in range(copies):
            mine = list(base)
            for at in r.choice(len(base), r.integers(0, 5), replace=False):
                mine[at] = f"w{r.integers(1000)}"
            rows.append((100 + k, " ".join(mine)))
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, node string")
    got = Counter(
        tuple(r)
        for r in minhash.near_duplicates(table, words, (num, 100)).select(
            "doc_id", "n_shingles", "component_id", "kept"
        ).collect()
    )
    assert got == exact_components(rows, words, num, 100)
    if not copies:
        assert minhash.near_duplicates(empty, words, (num, 100)).count() == 0


def brute_leaks(rows, items):
    """Every window of every text; an item of under five words is looked for in texts of no other words alone."""
    out = {}
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 5 else Counter(
        [tuple(w)]
    ) if w else Counter()
    weigh = lambda c: sum(len("".join(g)) * n for g, n in c.items())
    for (i, t), (item, q) in itertools.product(rows, items):
        w, own = split(t), split(q)
        if not w or (len(own) < 5 and w != own):
            continue
        for at in range(max(1, len(w) - len(own) + 1)):
            a, b = grams(w[at : at + len(own)]), grams(own)
            common, whole = weigh(a & b), weigh(a | b)
            if common and 100 * common >= 80 * whole:
                out[i, item] = max(out.get((i, item), 0), 1_000_000 * common // whole)
    return out


def test_decontamination(spark, docs, empty):
    items = [
        (1, LEAK),
        (2, None),
        (3, ""),
        (4, prose(20, 123)),
        (5, "one two"),
        (6, prose(12, 4).replace(".", ";")),
        (7, LEAK),
    ]
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, start int")
    got = {(r["doc_id"], r["item_id"]): r["similarity_ppm"] for r in decontamination.leaks(docs, benchmark).collect()}
    wanted = brute_leaks(TEXTS, items)
    assert got == wanted
    assert {(10, 1), (10, 7), (8, 5), (9, 5)} <= set(wanted)
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns and 10 not in {r["doc_id"] for r in left.collect()} and left.where(
        "doc_id IS NULL"
    ).count() == 1
    assert decontamination.leaks(empty, benchmark).count() == 0 and decontamination.clean(
        docs, benchmark.where("false")
    ).count() == docs.count()


def test_decontamination_slides_over_all_starts(spark):
    """Passages in another order, with words put in, taken out or repeated: the best of all windows counts."""
    w = [f"{x}{k}" for k, x in enumerate(VOCABULARY[:60])]
    around, more = prose(50, 31).split(), prose(9, 32).split()
    passages = {
        1: w[30:] + w[:30], 2: w[40:] + w[20:40] + w[:20], 3: w[:30] + more[:2] + w[30:], 4: w[:30] + more[:5] + w[
            30:
        ], 5: w[:20] + w[23:], 6: w[:12] + more[:3] + w[12:55],
        7: w[50:] + w[:50], 8: w + w[:30], 9: w[:30] * 4, 10: w[5:58], 11: w[:15] + more + w[15:], 12: w[30:] + more[
            :1
        ] + w[:30],
    }
    rows = [(i, " ".join(around[: 4 * i] + p + around[4 * i :])) for i, p in passages.items()] + [
        (20, " ".join(w[30:] + w[:30])), (21, " ".join(w[8:]))
    ]
    items = [(1, " ".join(w)), (2, " ".join(w[:30] + w[:30])), (3, " ".join(w[:7])), (4, " ".join(w[10:40]))]
    got = decontamination.leaks(
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    wanted = brute_leaks(rows, items)
    assert {(1, 1), (3, 1), (7, 1), (20, 1)} <= set(wanted)
    assert {(r["doc_id"], r["item_id"]): r["similarity_ppm"] for r in got.collect()} == wanted


def test_decontamination_of_odd_rows(spark):
    """Rows without an id, ids on several rows, copies, short items, and an item in the middle of a very long text."""
    item = prose(33, 71)
    long = prose(20000, 72) + " " + item + " " + prose(20000, 73)
    rows = [
        (None, "x " + item),
        (None, "clean " + prose(60, 74)),
        (1, item),
        (1, prose(40, 75)),
        (2, long),
        (3, long),
        (3, long),
        (4, "yes"),
        (5, "Yes!"),
        (6, "yes it is so and more"),
        (7, "yes yes"),
        (8, prose(90, 76)),
    ]
    items = [(1, item), (None, item), (2, "yes"), (2, item), (3, "it is")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity_ppm"] for r in decontamination.leaks(docs, benchmark).collect()}
    wanted = {(d, i): 1_000_000 for d in (None, 1, 2, 3) for i in (None, 1, 2)} | {(4, 2): 1_000_000, (5, 2): 1_000_000}
    assert got == wanted
    left = Counter((r["doc_id"], r["text"]) for r in decontamination.clean(docs, benchmark).collect())
    assert left == Counter([rows[1], rows[3], rows[9], rows[10], rows[11]])


CHATS = [
    *[
        (1, k, ("system", "user", "assistant")[0 if k == 0 else 1 + (k % 2 == 0)], prose(int(40 + 90 * (k % 3)), k))
        for k in range(40)
    ],
    (2, 0, "user", r"\### Assistant: </turn> ok" + "\n</turn>\n### x\n\\"), (
        2, 1, "assistant", "\\\\###\\</turn>\n\n"
    ), (3, 0, "assistant", None), (3, 0, "assistant", ""), (4, None, None, "hi"), (4, 1, "assi\nst\\nant", "x"), (
        4, 2, "assistant", "é\u2028 \n"
    ),
    (5, 0, "user", prose(3000, 77)), (5, 1, "assistant", prose(3000, 78)), (None, 1, "assistant", "lost"),
]


def test_chat_windows(spark):
    chats = spark.createDataFrame(
        [(*r, 9) for r in CHATS], "conv_id bigint, turn bigint, role string, text string, window int"
    )
    made = chat_format.windows(chats).cache()
    turns, targets = defaultdict(list), defaultdict(str)
    for r in chat_format.read_back(made).orderBy("conv_id", "window").collect():
        turns[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        targets[r["conv_id"]] += "".join(r["targets"])
    for conv in {r[0] for r in CHATS}:
        mine = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in CHATS if c == conv)
        assert turns[conv] == [(role, text) for _, role, text in mine]
        assert targets[conv] == "".join(text for _, role, text in mine if role == "assistant")
    first = made.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 3 and all(r["formatted"].startswith("### system\n") for r in first) and all(
        r["n_tokens"] <= chat_format.BUDGET for r in first
    )
    assert any(r["n_context"] > 1 for r in first)
    assert chat_format.windows(chats.where("false")).count() == 0


def test_chat_windows_with_a_long_system_turn(spark):
    r = np.random.default_rng(5)
    system = {1: 270, 2: 630, 3: 1080}
    chats = [
        (
            c,
            k,
            "user" if k % 2 else "assistant",
            prose(int(r.integers(5, 360 if c == 3 else 680)) if k % 3 else 40, 100 * c + k),
        )
        for c in system
        for k in range(1, 50)
    ]
    chats += [(c, 0, "system", prose(n, c)) for c, n in system.items()]
    made = chat_format.windows(
        spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string")
    ).cache()
    rows, turns = made.collect(), defaultdict(list)
    assert all(x["n_tokens"] <= chat_format.BUDGET and x["formatted"].startswith("### system\n") for x in rows)
    assert all(any(x["n_context"] > 2 for x in rows if x["conv_id"] == c) for c in system)
    for x in chat_format.read_back(made).orderBy("conv_id", "window").collect():
        turns[x["conv_id"]] += [t["text"] for t in x["turns"]]
    assert turns == {c: [t for i, _, _, t in sorted(chats) if i == c] for c in system}


def test_chat_windows_use_the_budget(spark):
    """Windows of short turns are nearly full, apart from the first and last of a conversation; none is over the
    budget."""
    r = np.random.default_rng(6)
    chats = [
        (c, k, "user" if k % 2 else "assistant", prose(int(r.integers(1, most)), 1000 * c + k))
        for c, most in ((1, 60), (2, 200), (3, 690))
        for k in range(1, 200)
    ]
    chats += [(c, 0, "system", prose(30, c)) for c in (1, 2)]
    rows = chat_format.windows(
        spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string")
    ).select("conv_id", "window", "n_tokens").collect()
    for c, share in ((1, 0.85), (2, 0.8), (3, 0.4)):
        mine = [x["n_tokens"] for x in sorted(rows, key=lambda x: x["window"]) if x["conv_id"] == c]
        assert max(mine) <= chat_format.BUDGET
        assert np.mean(mine[1:-1]) >= share * chat_format.BUDGET, (c, mine)


URLS = [
    None,
    "",
    "no scheme",
    "http://Example.ORG/es/1?q=1#x",
    "https://m.example.org/en/12",
    "https://example.org/en/2",
    "http://org/",
    "http://org",
    "http://a.com/fr/7",
    "http://a.com/de/7",
    "http://notcom/de/",
    "x://A.b://c/d#e?f",
    "http://spam-farm.example.net/a/b?x=1&y=2",
    "http://h?p#q",
    "http://éX.net/É",
]


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(
        (
            r
            for r in url_filter.RULES
            if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith(
                "/" + r[1].split("/", 1)[1]
            )
        ),
        key=lambda r: len(r[1]),
        default=(None, None),
    )
    return host, path, best[1], best[0]


def test_urls(spark, labels):
    pages = spark.createDataFrame(
        [(k, u, "own") for k, u in enumerate(URLS)], "page_id bigint, url string, host string"
    )
    rows = {r["page_id"]: r for r in url_filter.judged(pages, url_filter.UrlTrees()).collect()}
    for k, url in enumerate(URLS):
        host, path, rule, verdict = brute_rule(url)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"], rows[k]["verdict"]) == (
            host, path, rule, verdict or "allow"
        ), url
    assert url_filter.judged(pages.where("false"), url_filter.UrlTrees()).count() == 0


def auc(scores, truth):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    n = truth.sum()
    return (ranks[truth].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_url_trees_on_rows_held_out(spark):
    """Bad URLs have many hyphens, digits and parameters, or a bad suffix. Even documents are labelled, odd ones
    judged."""
    r = np.random.default_rng(8)
    urls, truth = [], []
    for k in range(1200):
        bad, word = bool(r.random() < 0.4), "".join(r.choice(list("abcdefghij"), 6))
        host = f"{word}-{r.integers(100)}-{word}-win" if bad and k % 3 else word
        suffix = "cheap.example" if bad and k % 3 == 0 else f"{r.choice(['firm', 'club', 'news'])}.example"
        urls.append((k, f"http://{host}.{suffix}/en/{k}" + (f"?a={k}&b={k}&c=1" if bad and k % 3 == 1 else "")))
        truth.append(bad)
    truth = np.array(truth)
    pages = url_filter.parsed(spark.createDataFrame(urls, "page_id bigint, url string"))
    labels = spark.createDataFrame(
        [(k, int(not truth[k]), 0) for k in range(0, 1200, 2)], "doc_id bigint, quality int, toxic int"
    )
    trees = url_filter.UrlTrees.fit(pages, labels, rounds=5)
    rows = {x["page_id"]: x for x in url_filter.judged(pages, trees, rules=()).collect()}
    odd = np.arange(1, 1200, 2)
    score = np.array([rows[k]["p_bad"] for k in odd])
    area = auc(score, truth[odd])
    right = np.mean([(rows[k]["verdict"] == "block") == truth[k] for k in odd])
    print(f"held out: AUC {area:.3f}, accuracy {right:.3f}")
    assert area > 0.95 and right > 0.9
    # Labels that have nothing to do with URLs teach nothing: by chance on rows held out.
    labels = spark.createDataFrame(
        [(k, int(r.random() < 0.5), 0) for k in range(0, 1200, 2)], "doc_id bigint, quality int, toxic int"
    )
    rows = {
        x["page_id"]: x
        for x in url_filter.judged(pages, url_filter.UrlTrees.fit(pages, labels, rounds=5), rules=()).collect()
    }
    assert 0.4 < auc(np.array([rows[k]["p_bad"] for k in odd]), r.random(600) < 0.5) < 0.6


def test_url_fitting_of_odd_tables(spark, labels):
    """Null and empty URLs and labels, columns named as the new ones, empty tables."""
    pages = spark.createDataFrame(
        [(k, u, "r", "v", 2.0, "s") for k, u in enumerate(URLS)] + [(50, "http://x.y/1", *["r", "v", 2.0, "s"])],
        "page_id bigint, url string, rule string, verdict string, p_bad double, suffix string",
    )
    odd = spark.createDataFrame(
        [(1, None, None), (None, 0, 1), (7, 0, 0), (7, 1, 0), (12, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    for known in (odd, odd.where("false"), labels):
        for some in (pages, pages.where("false"), pages.unionByName(pages)):
            rows = url_filter.judged(some, url_filter.UrlTrees.fit(url_filter.parsed(some), known, rounds=1))
            assert rows.count() == some.count() and {"rule", "verdict", "p_bad", "suffix"} <= set(rows.columns)
            assert rows.where("verdict NOT IN ('allow', 'block') OR suffix <> 's'").isEmpty()
    known = url_filter.labelled(url_filter.parsed(pages), odd).collect()
    assert {(x["url"], x["bad"]) for x in known} == {
        ("http://x.y/1", 0.0),
        ("https://m.example.org/en/12", 0.0),
        ("http://a.com/fr/7", 1.0),
        ("http://a.com/de/7", 1.0),
        ("http://Example.ORG/es/1?q=1#x", 0.0),
    }


def test_surrogates(docs, empty):
    rows = {r["doc_id"]: r for r in surrogates.replaced(docs, "k1").collect()}
    text = rows[13]["text"]
    for original in ("Ann.Lee@", "ann.lee@", "555-2671", "4111 1111", "10.20.30.40", "Jane Doe", "John Smith"):
        assert original not in text, original
    assert rows[13]["n_entities"] == 8
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", text)[1].replace(" ", "")
    assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card)) % 10 == 0
    mails = re.findall(r"[\w.]+@[\w.]+\w", text)
    assert len(mails) == 2 and len(set(mails)) == 1
    women = re.search(r"Mrs (\S+) (\S+) met Mr (\S+) (\S+) and Mrs (\S+)\.", text)
    assert women[4] == women[5] and women[1] in surrogates.GIVEN["f", "latin"] and women[3] in surrogates.GIVEN[
        "m", "latin"
    ]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)
    assert rows[1]["text"] == prose(80, 2) and rows[2]["text"] is None and rows[3]["text"] == ""
    assert surrogates.replaced(docs, "k1").count() == len(TEXTS) and surrogates.replaced(empty, "k1").count() == 0


def luhn(digits):
    return sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1], 1)) % 10 == 0


def iban(account):
    return int("".join(str(int(c, 36)) for c in (account[4:] + account[:4]).replace(" ", ""))) % 97 == 1


PEOPLE = [
    (
        1,
        "Dr Anna Müller met Frau Anna Müller. Then Prof. Anna Müller left; Mr Sam O'Brien and Mrs Sam Lee-Jones stayed.",
    ),
    (
        2,
        "My name is John Smith, mail john.smith@firm.com or J.SMITH77@firm.com, not smith@other.net, john.smith@other.net",
    ),
    (3, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, wrong DE12 3704 0044 0532 0130 00"),
    (4, "call 555-123-4567 or (415) 555-2671 or +49 30 1234567, card 4111-1111-1111-1111, not 4111 1111 1111 1112"),
    (5, "hosts 10.0.0.1, 10.0.0.2, fe80:0:0:0:0:0:0:1 and 2001:db8::ff00:42 and again 10.0.0.1; ssn 123-45-6789"),
    (6, "Господин Иван Петров и Госпожа Мария Петрова, Herr Müller"), (7, "no one here, 12 34, a@b, Mr x"), (8, None), (
        9, ""
    ),
    (10, "Mr Sam O'Brien wrote to 10.0.0.1 " * 400), (3, "the same id"), (None, "Frau Anna Müller"),
]


def test_surrogates_against_brute_force(spark):
    """The library's regular expressions find the entities; all else stays; entities and surrogates go one to one."""
    entity = regex.compile(surrogates.ENTITY)
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in PEOPLE], "doc_id bigint, text string, entity string, kind int"
    )
    got = {
        r["text"] if r["doc_id"] in (8, 9) else (r["doc_id"], k): r
        for k, r in enumerate(surrogates.replaced(docs, "k").collect())
    }
    rows = sorted(got.values(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))
    before = {i: [t for j, t in PEOPLE if j == i] for i, _ in PEOPLE}
    pairs, kinds = {}, Counter()
    for r in rows:
        options = before[r["doc_id"]]
        fits = False
        for t in options:
            spans = [m.span() for m in entity.finditer(t or "")]
            if len(spans) != r["n_entities"]:
                continue
            between = [
                (t or "")[a:b]
                for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t or "")], strict=True)
            ]
            m = regex.fullmatch("(.+?)".join(map(regex.escape, between)), r["text"] or "", regex.DOTALL)
            if m:
                fits = True
                assert (t is None) == (r["text"] is None)
                for (a, b), new in zip(spans, m.groups(), strict=True):
                    assert pairs.setdefault(t[a:b], new) == new
                    kinds[t[a:b]] += 1
        assert fits, r
    assert sum(len(entity.findall(t or "")) for _, t in PEOPLE) == sum(r["n_entities"] for r in rows) == sum(
        kinds.values()
    )
    lowered = defaultdict(set)
    for old, new in pairs.items():
        lowered[new.lower()].add(old.lower())
    assert all(len(v) == 1 for v in lowered.values()) and not set(pairs) & set(pairs.values())
    shape = lambda x: re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", x))
    for old, new in pairs.items():
        if re.match(r"[+(\d]", old) and "." not in old and ":" not in old:
            assert shape(old) == shape(new)
    assert luhn(re.sub(r"\D", "", pairs["4111-1111-1111-1111"])) and shape(pairs["GB82WEST12345698765432"]) == shape(
        "GB82WEST12345698765432"
    )
    assert iban(pairs["DE89 3704 0044 0532 0130 00"]) and iban(pairs["GB82WEST12345698765432"]) and pairs[
        "GB82WEST12345698765432"
    ][:2] == "GB"
    # One person, whatever the title; gender by all titles; words of addresses that are names go with them.
    anna = {pairs[x].split(" ", 1)[1] for x in pairs if x.endswith("Anna Müller")}
    assert len(anna) == 1 and anna.pop().split(" ")[0].split("-")[0] in surrogates.GIVEN["f", "latin"]
    assert pairs["Herr Müller"].split()[1] == pairs["Dr Anna Müller"].split()[2]
    assert pairs["Mr Sam O'Brien"].split()[1].split("-")[0] in surrogates.GIVEN["n", "latin"] and regex.fullmatch(
        r"[\p{IsCyrillic} -]+", pairs["Господин Иван Петров"]
    )
    first, last = pairs["John Smith"].lower().split()
    assert pairs["john.smith@firm.com"].split("@")[0] == f"{first}.{last}" and last.upper() in pairs[
        "J.SMITH77@firm.com"
    ]
    assert pairs["smith@other.net"].split("@")[1] == pairs["john.smith@other.net"].split("@")[1] != pairs[
        "john.smith@firm.com"
    ].split("@")[1]
    assert "10.0.0.1" not in "".join(r["text"] or "" for r in rows) and ipaddress.IPv6Address(
        pairs["2001:db8::ff00:42"]
    )


def test_surrogates_depend_on_a_key(spark):
    docs = spark.createDataFrame(PEOPLE[:3], "doc_id bigint, text string")
    one, two, again = (
        [r["text"] for r in surrogates.replaced(docs, k).orderBy("doc_id").collect()] for k in ("a", "b", "a")
    )
    assert one == again and one != two
    with pytest.raises(ValueError, match="key"):
        surrogates.replaced(docs, "")


def test_hmac(spark):
    for key in ("k", "x" * 100):
        made = spark.range(1).select(F.expr(surrogates.Keyed(key)("concat('née ', id)"))).first()[0]
        assert made == hmac.new(key.encode(), "née 0".encode(), "sha256").hexdigest()


def test_surrogates_stay_distinct(spark):
    entities = spark.range(3000).select(
        F.lit("surname").alias("kind"),
        F.concat(F.lit("N"), F.col("id").cast("string")).alias("norm"),
        F.lit("n").alias("gender"),
    )
    made = surrogates.mapped(entities, "k").collect()
    assert len({r["surrogate"] for r in made}) == 3000 and not {r["surrogate"] for r in made} & {
        r["norm"] for r in made
    }


def test_surrogates_of_a_dense_type(spark):
    """All numbers of two digits occur: they change places. A lone one of one digit does not need to."""
    some = [("maildigits", f"{k:02}") for k in range(100)] + [("maildigits", "7"), ("number", "55")]
    parts = spark.createDataFrame([(*x, "n") for x in some], "kind string, norm string, gender string")
    made = {(r["kind"], r["norm"]): r["surrogate"] for r in surrogates.mapped(parts, "k", 2).collect()}
    assert set(made) == set(some) and all(made[x] != x[1] for x in some)
    assert {made["maildigits", f"{k:02}"] for k in range(100)} == {f"{k:02}" for k in range(100)}


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS if i is not None]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.base.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == {1, 5, 6, 7, 10, 12, 13, 17, 18}
    kept = {c for (i, _, c, _) in exact_components([(i, t) for i, t in TEXTS if i in seen[0]], 5, 80, 100)}
    assert seen[1] == kept and seen[2] == kept - {10} and seen[3] == seen[2]
    assert "04dbebab" not in docs.where("doc_id = 12").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen[2] and zlib.crc32(packed[0]["ids"]) >= 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name, tmp_path):
    queries.QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    with duckdb.connect() as database:
        for t in ("documents", "benchmark", "conversations"):
            database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        columns = ", ".join(
            c[0] for c in database.execute(f"DESCRIBE SELECT * FROM '{tmp_path}/out/*.parquet'").fetchall()
        )
        own, sql = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({queries.SQL[name]})"
        for a, b in ((own, sql), (sql, own)):
            assert database.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchall() == [(0,)]
