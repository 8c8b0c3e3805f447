"""Surrogates for personal data, with DataFrame operations only.

E-mail addresses, phone, card and account numbers, network addresses and names are replaced by keyed ones of the same
type and format: digits stay digits in their places, a card or account number that passes its check digits still does, a
mail address keeps the pattern of letters, digits and marks before its ``@``, capitals stay capitals, a name keeps its
script and the gender that the titles before it in the corpus tell. Equal entities get equal surrogates in the whole
corpus; a person is known by the name, with or without whichever title, and a word of a mail address that is a name gets
that name's surrogate.

Surrogates come from HMAC-SHA-256 under a key that callers must give. A check over all distinct entities gives those
whose surrogate is taken, or is itself an entity of the corpus, another try; in a type so dense that tries run out, its
entities change places in an order that the key decides, which keeps them distinct too. So where nearly all values of a
shape are taken, a surrogate may be another entity's true value; callers who must rule that out keep such types out of
the text altogether.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segjobs.functions.ranking import ranked
from segjobs.llm import base

MAX_ROUNDS = 4
#: Session setting with the key of the query; without it the query takes this text, which is public.
KEY_SETTING, DEMO_KEY = "spark.segjobs.pii.key", "demonstration only"

# Titles by gender; the patterns by type, in the order in which they are tried; given names by gender and
# script.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MALE, FEMALE, ANY = "Mr|Herr|Monsieur|Señor|Sr|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа", "Dr|Prof"
_TITLE = rf"(?:{MALE}|{FEMALE}|{ANY})\.?"
_TITLES = rf"(?:{_TITLE} )++"
_PARTICLE = r"(?:de la|de las|de los|van de[rn]?|von de[rm]|del|della|de|da|dos|du|di|van|von|zu|zum|ter|ten|le|la|al|el|bin|ibn)"
_NAME = r"\p{Lu}\p{Ll}*+(?:['’-]\p{Lu}?\p{Ll}++)*+"
_INTRODUCED = r"[Mm]y name is |[Nn]ame: ?|[Cc]ontact: |[Ss]igned, |[Mm]ein Name ist |[Jj]e m'appelle |[Mm]e llamo |[Мм]еня зовут "
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "address": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "address6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
    "number": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLES}(?:{_NAME} )?(?:{_PARTICLE} )?{_NAME}(?!\p{{L}})|(?<={_INTRODUCED}){_NAME} (?:{_PARTICLE} )?{_NAME}(?!\p{{L}})",
}
GIVEN = {
    (
        "m", "latin"
    ): "James Peter Martin Paul Louis Hugo Felix Emil Carlos Diego Mateo Oscar Victor Simon Jonas Adrian".split(),
    (
        "f", "latin"
    ): "Anna Clara Marie Julia Sophie Emma Laura Elena Lucia Carmen Nora Alice Helena Ines Marta Vera".split(),
    (
        "n", "latin"
    ): "Robin Alex Kim Sam Charlie Jamie Dominique Andrea Sascha Noa Toni Luca Maxime Camille Ariel Jo".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Николай Павел Борис Олег".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Вера Нина Татьяна".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура".split(),
}
SYLLABLES = {
    "latin": "ba bel dor fen gar hal jen kel lin mar nor pel ran sol tan vel".split(),
    "cyrillic": "ба вел гор дан жар зим кол лев мор нов пет рог сав тал фед шир".split(),
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has a part of: texts without it are not searched.
HINT = rf"@|[A-Z]{{2}}\d{{2}}|\d[\d .():-]{{2}}|[0-9A-Fa-f]:|(?:{MALE}|{FEMALE}|{ANY})\.? |(?:{_INTRODUCED})"
DIGITS_ONLY = ("phone", "card", "number")


def _typed(x: Column) -> Column:
    """The type of an entity: the first whose pattern fits all of it; context before it is not there any more."""
    plain = {**PATTERNS, "name": ".*"}
    out = F.lit("name")
    for kind, pattern in reversed(plain.items()):
        out = F.when(x.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(title: Column) -> Column:
    return F.when(title.rlike(rf"(?:^| )(?:{MALE})\.?(?: |$)"), "m").when(
        title.rlike(rf"(?:^| )(?:{FEMALE})\.?(?: |$)"), "f"
    )


def _title(entity: Column) -> Column:
    """The titles that a name begins with, and the space after them; empty without."""
    return F.regexp_extract(entity, rf"^{_TITLES}", 0)


def _name_words(entity: Column) -> Column:
    """The words of a name after its titles, particles too."""
    return F.split(F.regexp_replace(entity, rf"^{_TITLES}", ""), " ")


def entities_of(found: DataFrame) -> DataFrame:
    """entity, kind, title (null without) and parts (kind, norm) of the distinct entities of rows (entities).

    A name's parts are its words with a capital: given name and surname; a word alone is a surname, unless it is one of
    the known given names. Particles such as "de la" stay as they are. A mail address's parts are the runs of letters
    and of digits before its ``@``, and its domain. Other entities are one part: their digits or letters.
    """
    own = found.select(F.explode("entities").alias("entity")).groupBy("entity").count().select("entity")
    own = own.withColumn("kind", _typed(F.col("entity")))
    own = own.withColumn(
        "title", F.when((F.col("kind") == "name") & (_title(F.col("entity")) != ""), F.rtrim(_title(F.col("entity"))))
    )
    own = own.withColumn("names", F.filter(_name_words(F.col("entity")), lambda w: w.rlike(r"^\p{Lu}")))
    part = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))
    last = F.size("names") - 1
    alone = lambda w: (last == 0) & w.isin(*sorted({n for names in GIVEN.values() for n in names}))
    name = F.transform("names", lambda w, i: part(F.when((i == last) & ~alone(w), "surname").otherwise("given"), w))
    local = F.regexp_extract_all(F.lower(F.regexp_extract("entity", "^[^@]*", 0)), F.lit(r"\p{L}+|\p{N}+"), 0)
    mail = F.transform(local, lambda w: part(F.when(w.rlike(r"^\p{N}"), "maildigits").otherwise("mailword"), w))
    mail = F.concat(mail, F.array(part(F.lit("maildomain"), F.lower(F.regexp_extract("entity", "@(.*)$", 1)))))
    digits = F.when(F.col("kind").isin(*DIGITS_ONLY), F.regexp_replace("entity", r"\D", ""))
    norm = F.coalesce(
        digits, F.when(F.col("kind") == "account", F.replace("entity", F.lit(" "), F.lit(""))), F.lower("entity")
    )
    parts = F.when(F.col("kind") == "name", name).when(F.col("kind") == "email", mail).otherwise(
        F.array(part(F.col("kind"), norm))
    )
    return own.select("entity", "kind", "title", parts.alias("parts"))


def distinct_parts(entities: DataFrame) -> DataFrame:
    """kind, norm and gender (m, f or n) of the distinct parts of entities. The gender of a given name is that of all
    the titles it has in the corpus; n if they differ or tell none. A word of a mail address that is also a name is left
    to that."""
    rows = entities.select("title", F.explode("parts").alias("p")).select(
        "p.kind", "p.norm", _gender(F.col("title")).alias("g")
    )
    own = rows.groupBy("kind", "norm").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    gender = F.when((F.col("kind") == "given") & (F.col("low") == F.col("high")), F.col("low")).otherwise("n")
    return own.select("kind", "norm", gender.alias("gender"))


class Keyed:
    """SQL for HMAC-SHA-256, in hexadecimal digits, under a key; only the padded keys are in the plan."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("a key is needed")
        raw = key.encode()
        raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
        self.inner, self.outer = (bytes(b ^ pad for b in raw.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))

    def __call__(self, message: str) -> str:
        inner = f"unhex(sha2(concat(unhex('{self.inner}'), encode({message}, 'UTF-8')), 256))"
        return f"sha2(concat(unhex('{self.outer}'), {inner}), 256)"


def _number(of: str, at: str, width: int = 6) -> str:
    """SQL for a number from ``width`` hexadecimal digits of a hash."""
    return f"CAST(conv(substr({of}, {at}, {width}), 16, 10) AS BIGINT)"


def _pick(words: list[str], at: int, of: str = "h") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({listed}), CAST(1 + {_number(of, str(at))} % {len(words)} AS INT))"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits."""
    double = f"CAST(substr('0246813579', CAST(substr({digits}, i, 1) AS INT) + 1, 1) AS INT)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + IF((length({digits}) - i) % 2 = 0, CAST(substr({digits}, i, 1) AS INT), {double}))"


def _mod97(account: str) -> str:
    """SQL: an account number's remainder by 97, with its first four characters last and letters as 10 to 35."""
    turned = f"concat(substr({account}, 5), substr({account}, 1, 4))"
    value = "IF(c BETWEEN '0' AND '9', CAST(c AS INT), ascii(c) - 55)"
    return f"aggregate(array_remove(split({turned}, ''), ''), 0, (a, c) -> IF(c BETWEEN '0' AND '9', (a * 10 + {value}) % 97, (a * 100 + {value}) % 97))"


def _drawn(alphabet: str, i: str = "i") -> str:
    """SQL: a letter of alphabet for place i, from the hash of its stretch of ten places; ``stream`` has those
    hashes."""
    at = f"1 + 6 * (({i} - 1) % 10)"
    return f"substr('{alphabet}', 1 + CAST({_number(f'stream[CAST(({i} - 1) DIV 10 AS INT)]', at)} % {len(alphabet)} AS INT), 1)"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: norm with each digit and letter drawn anew, and all else as it is.
_SHAPED = f"""array_join(transform(sequence(1, length(norm)), i -> CASE WHEN substr(norm, i, 1) RLIKE '[0-9]' THEN {_drawn("0123456789")}
    WHEN substr(norm, i, 1) RLIKE '[A-Z]' THEN {_drawn(_UPPER)} WHEN substr(norm, i, 1) RLIKE '\\\\p{{L}}' THEN {_drawn(_UPPER.lower())} ELSE substr(norm, i, 1) END), '')"""
_HEXED = f"array_join(transform(sequence(1, length(norm)), i -> IF(substr(norm, i, 1) = ':', ':', {_drawn('0123456789abcdef')})), '')"


def _surrogates() -> str:
    """SQL for the surrogate of (kind, norm, gender, script, attempt), from h and stream, its hashes, and shaped."""
    # An address of a private, local or loopback network stays one.
    network = "regexp_extract(norm, '^(?:10[.]|127[.]|169[.]254[.]|192[.]168[.]|172[.](?:1[6-9]|2[0-9]|3[01])[.])', 0)"
    drawn = ", ".join(f"CAST(1 + {_number('h', str(1 + 6 * k))} % 254 AS STRING)" for k in range(4))
    octets = f"concat({network}, array_join(slice(array({drawn}), 1, 4 - length(regexp_replace({network}, '[^.]', ''))), '.'))"
    # A phone number keeps what it has beyond its last ten digits: its country's number.
    phone = "IF(length(norm) > 10, concat(substr(norm, 1, length(norm) - 10), substr(shaped, 1, 10)), shaped)"
    stem = "substr(shaped, 1, length(norm) - 1)"
    card = f"IF({_luhn('norm')} % 10 = 0, concat({stem}, CAST((10 - {_luhn(f'concat({stem}, chr(48))')} % 10) % 10 AS STRING)), shaped)"
    country, rest = "substr(norm, 1, 2)", "substr(shaped, 5)"
    check = f"lpad(CAST(98 - {_mod97(f'concat({country}, chr(48), chr(48), {rest})')} AS STRING), 2, '0')"
    account = f"IF({_mod97('norm')} = 1, concat({country}, {check}, {rest}), concat({country}, substr(shaped, 3)))"
    names = []
    top = r"IF(norm RLIKE '[.](com|net|org)$', substr(norm, length(norm) - 2), 'org')"
    for script, syllables in SYLLABLES.items():
        word = " || ".join(_pick(syllables, 1 + 6 * k) for k in range(3))
        extra = f"array_join(transform(sequence(0, CAST(attempt AS INT) - 1), k -> {_pick(syllables, 1, 'stream[CAST(k AS INT)]')}), '')"
        grown = f"{word} || IF(attempt > 0, {extra}, '')"
        if script == "latin":
            names.append(f"WHEN kind = 'maildomain' THEN concat({grown}, '.example.', {top})")
        second = f"IF(norm LIKE '%-%', concat('-', initcap({' || '.join(_pick(syllables, 19 + 6 * k) for k in range(3))})), '')"
        names.append(f"WHEN kind = 'surname' AND script = '{script}' THEN initcap({grown}) || {second}")
        for gender in "mfn":
            given = f"{_pick(GIVEN[gender, script], 43)} || IF(norm LIKE '%-%', concat('-', {_pick(GIVEN[gender, script], 49)}), '')"
            names.append(
                f"WHEN kind = 'given' AND gender = '{gender}' AND script = '{script}' THEN {given} || IF(attempt > 0, concat('-', initcap({grown})), '')"
            )
    return f"CASE WHEN kind = 'address' THEN {octets} WHEN kind = 'address6' THEN {_HEXED} WHEN kind = 'phone' THEN {phone} WHEN kind = 'card' THEN {card} WHEN kind = 'account' THEN {account} {' '.join(names)} ELSE shaped END"


def _made(parts: DataFrame, keyed: Keyed) -> DataFrame:
    """parts (kind, norm, gender, attempt) with their surrogate."""
    message = "concat_ws('|', kind, norm, attempt)"
    # Little to read but much to reckon: over all tasks, whatever the size of the files.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = parts.repartition(tasks, "kind", "norm").withColumn("script", _script(F.col("norm"))).withColumn(
        "h", F.expr(keyed(message))
    )
    steps = f"sequence(0, greatest(CAST(length(norm) DIV 10 AS INT), CAST(attempt AS INT)))"
    stream = f"transform({steps}, k -> {keyed('concat_ws(' + chr(39) + '|' + chr(39) + ', h, k)')})"
    out = out.withColumn("stream", F.expr(stream)).withColumn("shaped", F.expr(_SHAPED))
    return out.select("kind", "norm", "gender", "attempt", F.expr(_surrogates()).alias("surrogate"))


#: Parts of one shape can stand for each other: same type, pattern of characters, gender and check digits' state.
_SHAPE = f"""concat_ws('|', kind, gender, regexp_replace(regexp_replace(regexp_replace(regexp_replace(norm, '[0-9]', '9'), '[A-Z]', 'A'), '\\\\p{{Lu}}', 'U'), '\\\\p{{Ll}}', 'l'),
    CAST(CASE WHEN kind = 'card' THEN {_luhn('norm')} % 10 = 0 WHEN kind = 'account' THEN {_mod97('norm')} = 1 ELSE FALSE END AS STRING), IF(kind = 'account', substr(norm, 1, 2), ''))"""


def mapped(parts: DataFrame, key: str, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(kind, norm, surrogate) of distinct parts (kind, norm, gender), distinct in each kind.

    Each round makes a surrogate for the parts that have none, and keeps it if it is no part of the corpus, nor
    made for another part before, or in this round for one that comes first. Parts whose rounds run out take each
    other's places, all of their shape in a circle by their hash; alone of its shape, a part waits for ten times as many
    rounds.
    """
    keyed = Keyed(key)
    parts = base.stored(parts.select("kind", "norm", "gender", F.expr(_SHAPE).alias("shape")))
    real = parts.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
    todo, done = parts.withColumn("attempt", F.lit(0).cast("long")), None
    for attempt in range(10 * rounds):
        made = base.stored(_made(todo, keyed))  # else the joins' filters would reckon all of it before it is spread
        first = made.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"), F.lit(True).alias("first"))
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate", F.lit(True).alias("taken")))
        made = made.join(first, ["kind", "surrogate", "norm"], "left").join(taken, ["kind", "surrogate"], "left")
        made = base.stored(
            made.select(
                "kind",
                "norm",
                "gender",
                "attempt",
                "surrogate",
                (F.col("taken").isNull() & F.col("first").isNotNull()).alias("good"),
            )
        )
        good = made.where("good").select("kind", "norm", "surrogate")
        done = good if done is None else done.unionByName(good)
        left = made.where("NOT good")
        if left.isEmpty():
            return done
        todo = left.select("kind", "norm", "gender", (F.col("attempt") + 1).alias("attempt"))
        if attempt == rounds - 1:
            todo, done = _circled(parts, todo, done, keyed)
            if todo.isEmpty():
                return done
    raise RuntimeError("a part alone of its shape still collides")


def _circled(parts: DataFrame, todo: DataFrame, done: DataFrame, keyed: Keyed) -> tuple[DataFrame, DataFrame]:
    """(todo, done) after all parts of the shapes that todo has, if there are two or more, moved on by one in a
    circle."""
    shapes = parts.groupBy("shape").agg(F.count("*").alias("many")).where("many > 1")
    shapes = base.stored(
        parts.join(todo.select("kind", "norm"), ["kind", "norm"], "left_semi").select("shape").distinct().join(
            shapes, "shape"
        )
    )
    dense = parts.join(base.small(shapes), "shape").withColumn(
        "h", F.expr(keyed("concat_ws('|', kind, norm, 'circle')"))
    )
    dense = base.stored(ranked(dense, "shape", "h", "norm"))
    starts = dense.groupBy("shape").agg(F.min("rank").alias("start"))
    dense = dense.join(base.small(starts), "shape").withColumn("at", F.col("rank") - F.col("start"))
    after = dense.select(
        "shape", ((F.col("at") + F.col("many") - 1) % F.col("many")).alias("at"), F.col("norm").alias("surrogate")
    )
    moved = base.stored(
        dense.select("shape", "at", "kind", "norm").join(after, ["shape", "at"]).select("kind", "norm", "surrogate")
    )
    known = moved.select("kind", "norm")
    still = base.stored(todo.join(known, ["kind", "norm"], "left_anti"))
    return still, done.join(known, ["kind", "norm"], "left_anti").unionByName(moved)


def _formatted() -> Column:
    """The entity in its own format; found holds the surrogates of its parts, in order."""
    one = F.col("found")[0]
    # Digits (of an account number: letters too) are replaced in their places; all else stays.
    placed = F.aggregate(
        F.array_remove(F.split("entity", ""), ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(
            c.rlike("[0-9A-Z]"),
            F.struct(F.concat(a["s"], F.substring(one, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k")),
        )
        .otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
    )["s"]
    local = F.regexp_extract("entity", "^[^@]*", 0)
    marks = F.split(local, r"\p{L}+|\p{N}+", -1)
    words, domain = F.expr("slice(found, 1, greatest(size(found) - 1, 0))"), F.element_at("found", -1)
    filled = F.array_join(
        F.flatten(F.zip_with(marks, F.concat(words, F.array(F.lit(""))), lambda a, b: F.array(a, b))), ""
    )
    cased = lambda of, x: F.when((of == F.upper(of)) & (of != F.lower(of)), F.upper(x)).otherwise(x)
    email = F.concat(cased(local, filled), F.lit("@"), domain)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("k"))
    word = lambda a, w: F.when(
        w.rlike(r"^\p{Lu}"),
        F.struct(F.concat(a["out"], F.array(F.get("found", a["k"]))).alias("out"), (a["k"] + 1).alias("k")),
    )
    words = F.aggregate(
        _name_words(F.col("entity")),
        empty,
        lambda a, w: word(a, w).otherwise(F.struct(F.concat(a["out"], F.array(w)).alias("out"), a["k"].alias("k"))),
    )
    name = F.concat(_title(F.col("entity")), F.array_join(words["out"], " "))
    address6 = cased(F.col("entity"), one)
    kind = F.col("kind")
    return F.when(kind == "email", email).when(kind == "address", one).when(kind == "address6", address6).when(
        kind == "name", name
    ).otherwise(placed)


def surrogates_of(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate, words) of entities_of()'s rows; words: norm and surrogate of the words of names."""
    parts = base.stored(distinct_parts(entities))
    names = parts.where("kind IN ('given', 'surname')").select(F.lower("norm").alias("low"), "kind", "norm")
    names = base.stored(names.groupBy("low").agg(F.min(F.struct("kind", "norm")).alias("name")))
    # A word of a mail address that is a name goes by the name's surrogate; others by their own.
    words = parts.where("kind = 'mailword'").join(names, F.col("norm") == F.col("low"), "left_semi").select(
        "kind", "norm"
    )
    words = base.stored(words)
    known = base.stored(mapped(parts.join(words, ["kind", "norm"], "left_anti"), key))
    linked = words.join(names, F.col("norm") == F.col("low")).select(
        "kind", "norm", F.col("name.kind").alias("of_kind"), F.col("name.norm").alias("of_norm")
    )
    of = known.select(
        F.col("kind").alias("of_kind"), F.col("norm").alias("of_norm"), F.lower("surrogate").alias("surrogate")
    )
    known = known.unionByName(linked.join(of, ["of_kind", "of_norm"]).select("kind", "norm", "surrogate"))
    pieces = entities.select("entity", "kind", "title", F.posexplode_outer("parts").alias("k", "p"))
    pieces = pieces.select("entity", F.col("kind").alias("of"), "title", "k", "p.kind", "p.norm").join(
        known, ["kind", "norm"], "left"
    )
    found = F.array_sort(F.collect_list(F.struct("k", "surrogate", "norm")))
    whole = pieces.groupBy("entity").agg(F.first("of").alias("kind"), F.first("title").alias("title"), found.alias("s"))
    words = F.expr(
        "IF(kind = 'name', transform(filter(s, x -> x.surrogate IS NOT NULL), x -> struct(x.norm, x.surrogate)), array())"
    )
    whole = whole.select(
        "entity",
        "kind",
        "title",
        F.expr("filter(s.surrogate, x -> x IS NOT NULL)").alias("found"),
        words.alias("words"),
    )
    made = base.stored(whole.select("entity", "kind", _formatted().alias("surrogate"), "words"))
    # Words of mail addresses are replaced one by one; should two addresses meet after all, both get a mark of their
    # own.
    mails = made.where("kind = 'email'").groupBy(F.lower("surrogate").alias("met")).agg(
        F.min(F.lower("entity")).alias("x"), F.max(F.lower("entity")).alias("y")
    )
    mails = made.join(
        base.small(base.stored(mails.where("x < y").select("met"))), F.lower("surrogate") == F.col("met"), "left"
    )
    mark = F.expr(f"substr({Keyed(key)('lower(entity)')}, 1, 12)")
    own = F.when(F.col("met").isNotNull(), F.concat_ws(".", mark, "surrogate")).otherwise(F.col("surrogate"))
    return mails.select("entity", own.alias("surrogate"), "words")


#: A text as words and what stands between them: a word goes on over a hyphen or apostrophe if a capital follows.
_TOKENS = r"\p{L}++(?:['’-]\p{Lu}\p{L}*+)*+|[^\p{L}]++"


def _mentions(part: Column, names: Column) -> Column:
    """A part of a text with the words of names (norm and surrogate, ordered) replaced."""
    known = F.array_distinct(F.transform(names, lambda n: n["norm"]))
    of = F.map_from_arrays(
        known, F.transform(known, lambda w: F.filter(names, lambda n: n["norm"] == w)[0]["surrogate"])
    )
    return F.array_join(
        F.transform(F.regexp_extract_all(part, F.lit(_TOKENS), 0), lambda t: F.coalesce(F.try_element_at(of, t), t)), ""
    )


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_entities. All columns and rows stay; a column n_entities is replaced.

    A null or empty text stays as it is, with 0 entities. Repeated rows are changed alike. Very long texts are read
    whole. An empty table gives no rows. A text in which a person is found has that person's words replaced wherever
    they stand as whole words, with a title or without; n_entities does not count those. One pass over all texts; only
    rows with entities are shuffled, and of equal texts one is looked up. Without a key there is an error.
    """
    Keyed(key)
    docs = docs.drop("n_entities")
    own = docs.columns
    text = F.coalesce("text", F.lit(""))
    searched = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(
        F.array().cast("array<string>")
    )
    found = base.stored(docs.select(F.struct(*own).alias("row"), searched.alias("entities")))
    some = found.where(F.size("entities") > 0).withColumn("text_key", F.sha2("row.text", 256))
    entities = base.stored(entities_of(some))
    new = base.stored(surrogates_of(entities, key))
    texts = some.groupBy("text_key").agg(F.first("entities").alias("entities")).select(
        "text_key", F.posexplode("entities").alias("at", "entity")
    )
    texts = texts.join(base.small(new), "entity").groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("names"),
    )
    texts = base.small(base.stored(texts))
    between = F.split("row.text", ENTITY, -1)
    between = F.when(F.size("names") > 0, F.transform(between, lambda part: _mentions(part, F.col("names")))).otherwise(
        between
    )
    text = F.array_join(
        F.flatten(F.zip_with(between, F.concat(F.col("s.surrogate"), F.array(F.lit(""))), lambda a, b: F.array(a, b))),
        "",
    )
    changed = some.join(texts, "text_key")
    changed = changed.select(
        *[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in own],
        F.size("entities").cast("long").alias("n_entities"),
    )
    same = found.where(F.size("entities") == 0).select("row.*", F.lit(0).cast("long").alias("n_entities"))
    return same.unionByName(changed)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, DEMO_KEY)
    return replaced(base.table(spark, sf_dir, "documents").select("doc_id", "text"), key)


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}
#: No SQL: tests compare with brute force over the same patterns, and check distinctness, formats and coreference.
SQL: dict[str, str] = {}
