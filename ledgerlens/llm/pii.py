"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Every detected value becomes another value of its kind: same length and punctuation, letters for
letters of the same case and script, digits for digits, given names for given names of the same
gender and script, cards with the same Luhn status, addresses with the same top-level domain. A
surrogate follows from a secret key, the kind and the value alone, so all mentions of one value
agree in every document and run.

Two values of a kind that would get one surrogate, and surrogates that are somebody's real value,
are found over all distinct values of the corpus and drawn again. Such exceptions are few; they
reach the texts they occur in through a join on the text's digest, and every other text is
rewritten in one pass without a shuffle.

A person found once is found again in the same text by any part of the name alone: after "Mr Jones"
every word "Jones" of that text is replaced. Account numbers (IBAN) keep country and validity, IPv6
addresses their first four characters and their grouping.

Not found: people without a title or a listed given name before them, IPv6 addresses that start
with ``::`` or are shortened outside the global, local and link ranges, and secrets with neither a
key word nor a known prefix. Two ways of shortening one IPv6 address are two values.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, unused, written

KEY_SETTING = "spark.ledgerlens.surrogateKey"
DEFAULT_KEY = "set spark.ledgerlens.surrogateKey to a secret of your own"
GROW_AFTER = 8
"""Attempts after which surrogates get longer, so that a full space of short values cannot stall."""

# Fixed lists of common given names by gender and script; surrogates are drawn from the same list.
GIVEN = {
    "latin female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Nancy Margaret Emily Anna Julia Claire Camille Ingrid Ursula Sabine Carmen Lucia Elena Sofia",
    "latin male": "James Robert John Michael David William Richard Joseph Thomas Charles "
    "Daniel Matthew Peter Paul Pierre Jacques Hans Stefan Klaus Jürgen Carlos Miguel Javier Pablo",
    "cyrillic female": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия",
    "cyrillic male": "Александр Дмитрий Сергей Иван Михаил Николай Владимир Алексей Павел Андрей",
    "greek female": "Μαρία Ελένη Αικατερίνη Σοφία Γεωργία Ιωάννα",
    "greek male": "Γεώργιος Ιωάννης Νικόλαος Δημήτριος Παναγιώτης Βασίλειος",
}
TITLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Mme Señor Señora".split()

# Nothing is found inside a word. This one test comes first, as it fails at most places; then each
# kind looks at the first character before anything dearer.
START = r"(?<![\p{L}\p{N}])"
# Apostrophes and hyphens join letters; the "s" of a genitive is no part of a name.
NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L}))){1,40}"
_GIVEN_WORDS = "|".join(n for names in GIVEN.values() for n in names.split())
PERSON = (
    rf"(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? (?:{NAME} )?{NAME}"
    rf"|(?:{_GIVEN_WORDS}) {NAME})"
)
SECRET_KEYS = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
# A key may stand in quotes, as in JSON. A bearer token needs no key if there is a digit in it.
SECRET_LEAD = (
    rf"(?i:{SECRET_KEYS}[\"']? ?[=:] ?[\"']?(?:bearer )?|bearer (?=[^\s\"',;\d]*\d))"
)
SECRET = rf"(?=[pPsStTaAbB]){SECRET_LEAD}[^\s\"',;]{{6,}}+"
AWS = r"A(?:KIA|SIA)[0-9A-Z]{16}\b"
EMAIL = r"(?=[\p{L}\p{N}._%+-])(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?=\d)(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
# Groups after the second hold a digit, so that a word in capitals is no part of a number.
IBAN = (
    r"(?=[A-Z]{2}\d\d)[A-Z]{2}\d\d ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,6}"
    r"(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
)
HEX = "[0-9A-Fa-f]"
IPV6 = (
    rf"(?={HEX}{{1,4}}:)(?<!:)(?:(?:{HEX}{{1,4}}:){{7}}{HEX}{{1,4}}"
    rf"|(?=[23fF]{HEX}{{3}}:)(?:{HEX}{{1,4}}:){{1,6}}(?::{HEX}{{1,4}}){{1,6}}"
    rf"|(?=[23fF]{HEX}{{3}}:)(?:{HEX}{{1,4}}:){{1,7}}:)(?![\p{{L}}\p{{N}}:])"
)
SSN = r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?=[2-6])(?<!-)[2-6](?:[ -]?\d){12,18}(?![\d-])"
PHONE = (
    r"(?=[+(\d])(?<!\+)(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d))"
)
KINDS = {
    "secret": SECRET,
    "access key": AWS,
    "email": EMAIL,
    "iban": IBAN,
    "ipv6": IPV6,
    "ssn": SSN,
    "card": CARD,
    "ip": IP,
    "phone": PHONE,
    "person": PERSON,
}
"""Kinds in the order in which they are tried at a place in the text."""
KNOWN = START + "(?:" + "|".join(f"(?:{p})" for p in KINDS.values())
ANY = KNOWN + ")"
# A part of a name that stands alone, where no kind is found.
ALONE = r")(?![\p{L}\p{N}]|['’-](?=\p{L})(?!s(?!\p{L}))))"
MARK = "\u0001"

DIGITS = "0123456789"
LATIN = "abcdefghijklmnopqrstuvwxyz"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
# Letters of other scripts are drawn from their own script.
SCRIPTS = [
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ",
    "".join(chr(c) for c in range(0x4E00, 0x4E80)),
    "".join(chr(c) for c in range(0x05D0, 0x05EB)),
    "".join(chr(c) for c in range(0x0627, 0x064B)),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated and planned once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _given_map(key: str) -> dict[str, str]:
    """A keyed permutation of each list in which no name keeps its place."""
    found = {}
    for group, names in GIVEN.items():
        order = names.split()
        random.Random(f"{key}|{group}").shuffle(order)
        found |= dict(zip(order, order[1:] + order[:1], strict=True))
    return found


def kind_of(found: Column) -> Column:
    """The kind a detected string was found as."""
    first, *rest = [
        (F.rlike(found, F.lit(f"^(?:{pattern})$")), F.lit(kind)) for kind, pattern in KINDS.items()
    ]
    column = F.when(*first)
    for test, kind in rest:
        column = column.when(test, kind)
    return column.otherwise("person")


SECRET_HEAD = "^" + SECRET_LEAD
# A mark that ends the sentence or bracket is no part of the secret before it.
SECRET_TAIL = r"(?<=[\p{L}\p{N}])[.!?)]$"
# Country codes of one and of two digits; all others have three.
PHONE_HEAD = (
    r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
)


def canonical(kind: Column, found: Column) -> Column:
    """What all spellings of one value share."""
    digits = F.regexp_replace(found, r"\D", "")
    return (
        F.when(
            kind == "secret",
            F.regexp_replace(F.regexp_replace(found, SECRET_HEAD, ""), SECRET_TAIL, ""),
        )
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(found, PHONE_HEAD, ""), r"\D", ""))
        .when(kind == "card", digits)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind.isin("email", "name", "ipv6"), F.lower(found))
        .otherwise(found)
    )


def _drawn(key: str, kind: Column, seed: Column, value: Column, attempt: Column, hexed) -> Column:
    """``value`` with every letter and digit replaced, by a stream keyed on ``seed``."""
    # Numbers and characters are arrays and blocks hash a digest of the seed, so that a long value
    # takes time in proportion to its length.
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(value) - 1, F.lit(0)) / 32))

    def block(b: Column, seeded: Column) -> Column:
        return let(
            F.sha2(F.concat_ws("|", F.lit(key), kind, attempt, b, seeded), 256),
            lambda digest: F.transform(
                F.sequence(F.lit(1), F.lit(63), F.lit(2)),
                lambda at: F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int"),
            ),
        )

    stream = let(
        F.sha2(seed, 256), lambda seeded: F.flatten(F.transform(blocks, lambda b: block(b, seeded)))
    )

    def drawn_from(char: Column, lower: Column, number: Column) -> Column:
        def of(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))

        def within(alphabet: str) -> Column:
            return F.instr(F.lit(alphabet), lower) > 0

        drawn = F.when(within(DIGITS), of(DIGITS))
        drawn = drawn.when(hexed & within("abcdef"), of("abcdef"))
        drawn = drawn.when((kind == "name") & within(VOWELS), of(VOWELS))
        drawn = drawn.when((kind == "name") & within(LATIN), of(CONSONANTS))
        for alphabet in (LATIN, *SCRIPTS):
            drawn = drawn.when(within(alphabet), of(alphabet))
        drawn = drawn.when(F.rlike(char, F.lit(r"^\p{N}$")), of(DIGITS))
        drawn = drawn.when(F.rlike(char, F.lit(r"^\p{L}$")), of(LATIN)).otherwise(lower)
        return let(drawn, lambda d: F.when(char == lower, d).otherwise(F.upper(d)))

    def draw(char: Column, number: Column) -> Column:
        return let(F.lower(char), lambda lower: drawn_from(char, lower, number))

    numbers = F.slice(stream, F.lit(1), F.length(value))
    drawn = F.array_join(F.zip_with(F.split(value, ""), numbers, draw), "")
    return F.when(F.length(value) == 0, value).otherwise(drawn)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo ten."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(
        F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b
    ) % 10


def _mod97(iban: Column) -> Column:
    """The number an IBAN stands for, letters as 10 to 35 and its first four at the end, modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def onto(total: Column, char: Column) -> Column:
        worth = F.instr(F.lit(DIGITS + LATIN.upper()), char) - 1
        return (total * F.when(worth > 9, 100).otherwise(10) + worth) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), onto)


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of a canonical value; ``attempt`` counts earlier draws that clashed."""
    whole = F.struct(
        kind.alias("kind"),
        value.alias("value"),
        F.repeat(F.lit("7"), F.greatest(attempt - GROW_AFTER, F.lit(0))).alias("more"),
        F.sha2(F.concat_ws("|", F.lit(key), kind, attempt, value), 256).alias("digest"),
        ((kind == "ipv6") | (kind == "secret") & F.rlike(value, F.lit("^[0-9a-f]+$"))).alias("hexed"),
    )

    def choose(x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        grown = F.concat(value, x["more"])
        drawn = _drawn(key, kind, value, grown, attempt, x["hexed"])
        return (
            F.when(kind == "email", _email(key, x, attempt))
            .when(kind == "ip", F.concat_ws(".", _octet(x, 0) % 223 + 1, *[_octet(x, i) for i in (1, 2, 3)]))
            .otherwise(let(drawn, lambda d: _shaped(x, d)))
        )

    return let(whole, choose)


def _octet(x: Column, i: int) -> Column:
    return F.conv(F.substring(x["digest"], 2 * i + 1, 2), 16, 10).cast("int")


def _email(key: str, x: Column, attempt: Column) -> Column:
    """Addresses of one domain stay together, and the top-level domain stays as it is."""
    no = F.lit(False)
    local = let(
        F.concat(F.regexp_extract(x["value"], "^([^@]*)@", 1), x["more"]),
        lambda v: _drawn(key, x["kind"], x["value"], v, attempt, no),
    )
    host = let(
        F.regexp_extract(x["value"], "@(.*)[.]", 1),
        lambda v: _drawn(key, F.lit("domain"), v, v, F.lit(0), no),
    )
    return F.concat(local, F.lit("@"), host, F.regexp_extract(x["value"], "([.][^.]*)$", 1))


def _shaped(x: Column, drawn: Column) -> Column:
    """``drawn`` with what a kind keeps of the value."""
    kind, value, size = x["kind"], x["value"], F.length(drawn)
    # Another check digit keeps a number valid, or off by as much as it was.
    body = F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), size - 2))
    card = let(
        body,
        lambda b: F.concat(
            b, ((_luhn(value) - _luhn(F.concat(b, F.lit("0"))) + 10) % 10).cast("string")
        ),
    )
    # The first digit of an area code is no 0 or 1.
    lead = F.concat((_octet(x, 0) % 8 + 2).cast("string"), F.substring(drawn, F.lit(2), size))
    tail = F.substring(drawn, F.lit(5), size)
    prefixed = F.concat(F.substring(value, 1, 4), tail)
    country = F.substring(value, 1, 2)
    # 98 less the rest over zeros makes a number valid; another one keeps the digits that were drawn.
    zeros = let(F.concat(country, F.lit("00"), tail), lambda z: (98 - _mod97(z)).cast("string"))
    sums = F.when(_mod97(value) == 1, F.lpad(zeros, 2, "0")).otherwise(F.substring(drawn, 3, 2))
    return (
        F.when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), lead)
        .when(kind == "iban", F.concat(country, sums, tail))
        .when(kind.isin("access key", "ipv6"), prefixed)
        .otherwise(drawn)
    )


def _digits_into(form: Column, digits: Column, other: str = r"\D") -> Column:
    """``form`` with its digits replaced in order; digits left over follow at its end.

    ``other`` is the pattern of the characters that stay.
    """

    def put(i: Column) -> Column:
        char = F.substring(form, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), other, ""))
        return F.when(
            F.rlike(char, F.lit(other)), char
        ).otherwise(F.substring(digits, before, F.lit(1)))

    used = F.length(F.regexp_replace(form, other, ""))
    return F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), put), ""),
        F.substring(digits, used + 1, F.length(digits)),
    )


def _cased_like(form: Column, value: Column) -> Column:
    """``value`` with the capitals of ``form``."""

    def put(i: Column) -> Column:
        char, model = (F.substring(x, i, F.lit(1)) for x in (value, form))
        return F.when(model != F.lower(model), F.upper(char)).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), put), "")


def _is_title(token: Column) -> Column:
    return F.regexp_replace(token, "[.]$", "").isin(*TITLES)


class Surrogates:
    """Detection and replacement under one key."""

    def __init__(self, key: str):
        self.key = key
        given = _given_map(key)
        self.given = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        self.names = list(given)

    def values(self, found: Column) -> Column:
        """The ``kind, value`` pairs that need a surrogate in one detected string."""

        def of(kind: Column) -> Column:
            tokens = F.filter(F.split(found, " "), lambda t: ~_is_title(t) & ~t.isin(*self.names))
            return F.when(
                kind == "person", F.transform(tokens, lambda t: self._pair(F.lit("name"), t))
            ).otherwise(F.array(self._pair(kind, found)))

        return let(kind_of(found), of)

    def _pair(self, kind: Column, found: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical(kind, found).alias("value"))

    def replacement(self, found: Column, patches: Column) -> Column:
        """The new text of one detected string."""

        def given_or_drawn(token: Column) -> Column:
            new = let(
                self._final(F.lit("name"), token, patches), lambda n: _cased_like(token, n)
            )
            return (
                F.when(_is_title(token), token)
                .when(token.isin(*self.names), F.element_at(self.given, token))
                .otherwise(new)
            )

        def formed(kind: Column, new: Column) -> Column:
            lead, tail = (F.regexp_extract(found, p, 0) for p in (SECRET_HEAD, SECRET_TAIL))
            head = F.regexp_extract(found, PHONE_HEAD, 0)
            body = F.regexp_replace(found, PHONE_HEAD, "")
            return (
                F.when(kind == "secret", F.concat(lead, new, tail))
                .when(
                    kind == "phone",
                    F.concat(head, let(body, lambda b: _digits_into(b, new))),
                )
                .when(kind == "card", _digits_into(found, new))
                .when(kind == "iban", _digits_into(found, new, " "))
                .when(kind.isin("email", "ipv6"), _cased_like(found, new))
                .otherwise(new)
            )

        person = F.array_join(F.transform(F.split(found, " "), given_or_drawn), " ")
        return let(
            kind_of(found),
            lambda kind: F.when(kind == "person", person).otherwise(
                let(self._final(kind, found, patches), lambda new: formed(kind, new))
            ),
        )

    def _final(self, kind: Column, found: Column, patches: Column) -> Column:
        return let(
            canonical(kind, found),
            lambda value: F.coalesce(
                F.element_at(patches, F.concat_ws("|", kind, value)),
                surrogate(self.key, kind, value, F.lit(0)),
            ),
        )

    @staticmethod
    def repeats(found: Column) -> Column:
        """A pattern for all kinds and for any part of the names found; null if there is no name."""
        people = F.filter(found, lambda f: F.rlike(f, F.lit(f"^(?:{PERSON})$")))
        parts = F.transform(people, lambda f: F.filter(F.split(f, " "), lambda t: ~_is_title(t)))
        return let(
            F.array_distinct(F.flatten(parts)),
            lambda names: F.when(
                F.size(names) > 0, F.concat(F.lit(f"{KNOWN}|(?:"), F.array_join(names, "|"), F.lit(ALONE))
            ),
        )

    def entities(self, docs: DataFrame) -> DataFrame:
        """``key, kind, value``: what each distinct text holds, once."""
        found = F.regexp_extract_all("text", F.lit(ANY), 0)
        rows = docs.filter("text is not null").select(
            F.md5("text").alias("key"), F.explode(F.array_distinct(found)).alias("found")
        )
        pairs = rows.select("key", F.explode(self.values(F.col("found"))).alias("pair"))
        return pairs.select("key", "pair.kind", "pair.value").distinct()

    def exceptions(self, values: DataFrame) -> DataFrame:
        """``kind, value, surrogate`` of values whose first draw clashed.

        Of values with one draw the smallest keeps it. A draw that is a real value of the corpus
        is never used. Draws are repeated until every value has one of its own.
        """
        real = values.select("kind", F.col("value").alias("surrogate"))
        open_values, settled, attempt = values, None, 0
        while True:
            drawn = open_values.withColumn(
                "surrogate", surrogate(self.key, F.col("kind"), F.col("value"), F.lit(attempt))
            )
            drawn = written(drawn, "surrogates")
            first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
            free = first.join(real, ["kind", "surrogate"], "left_anti")
            if settled is not None:
                taken = settled.select("kind", "surrogate")
                free = free.join(taken, ["kind", "surrogate"], "left_anti")
            good = written(free.select("kind", "value", "surrogate"), "settled")
            settled = good if settled is None else settled.union(good)
            open_values = written(
                drawn.join(good, ["kind", "value"], "left_anti").select("kind", "value"), "clashes"
            )
            if attempt == 0:
                usual = good
            attempt += 1
            if not open_values.limit(1).count():
                return settled.join(usual, ["kind", "value"], "left_anti") if attempt > 1 else None


def replace(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of replaced strings in ``n_replaced``.

    A null text stays null with a null count; texts without findings are unchanged. Columns other
    than ``text`` pass through; one called ``n_replaced`` is replaced. The key comes from
    ``spark.ledgerlens.surrogateKey`` if it is not given.
    """
    if key is None:
        key = docs.sparkSession.conf.get(KEY_SETTING, DEFAULT_KEY)
    own = Surrogates(key)
    held = written(own.entities(docs), "entities")
    odd = own.exceptions(held.select("kind", "value").distinct())
    docs = docs.drop("n_replaced")
    key_, patches_, found_, repeats_, between_, new_ = (
        unused(docs, f"pii_{c}") for c in ("key", "patches", "found", "repeats", "between", "new")
    )
    rows = docs.withColumn(found_, F.regexp_extract_all("text", F.lit(ANY), 0))
    rows = rows.withColumn(repeats_, own.repeats(F.col(found_)))
    again = F.regexp_extract_all("text", F.col(repeats_), 0)
    rows = rows.withColumn(found_, F.when(F.col(repeats_).isNull(), F.col(found_)).otherwise(again))
    if odd is None:
        rows = rows.withColumn(patches_, F.lit(None).cast("map<string,string>"))
    else:
        # The map of a text holds no more than the values of that text.
        entry = F.struct(F.concat_ws("|", "kind", "value"), "surrogate")
        patches = held.join(odd, ["kind", "value"]).groupBy(F.col("key").alias(key_)).agg(
            F.map_from_entries(F.collect_list(entry)).alias(patches_)
        )
        rows = rows.withColumn(key_, F.md5("text"))
        rows = rows.join(written(patches, "patches"), key_, "left")
    between = F.when(
        F.col(repeats_).isNotNull(), F.split("text", F.col(repeats_), -1)
    ).when(
        F.contains(F.col("text"), F.lit(MARK)), F.split("text", ANY, -1)
    ).otherwise(F.split(F.regexp_replace("text", ANY, MARK), MARK, -1))
    # Pieces between findings, each but the first led by the replacement before it.
    rest = F.zip_with(
        F.col(found_),
        F.slice(F.col(between_), 2, F.size(found_)),
        lambda found, piece: F.concat(own.replacement(found, F.col(patches_)), piece),
    )
    text = F.when(F.size(found_) == 0, F.col("text")).otherwise(
        F.concat(F.element_at(between_, 1), F.array_join(rest, ""))
    )
    rows = rows.withColumn(between_, F.when(F.size(found_) > 0, between))
    rows = rows.withColumn(new_, F.when(F.col("text").isNotNull(), text))
    count = F.when(F.col("text").isNotNull(), F.size(found_).cast("long"))
    return rows.select(
        *[F.col(new_).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        count.alias("n_replaced"),
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for what it holds of personal data and secrets."""
    docs = read_table(spark, sf_dir, "documents")
    return replace(docs).select("doc_id", "text", "lang", "source", "n_replaced")


def surrogates_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, texts with surrogates, ``n_chars`` moved with the length."""
    # A column named like the count is set aside by another name meanwhile.
    length, count = unused(docs, "pii_length"), unused(docs, "n_replaced")
    before = docs.withColumnRenamed("n_replaced", count).withColumn(length, F.length("text"))
    grown = F.coalesce(F.length("text") - F.col(length), F.lit(0))
    after = replace(before).drop("n_replaced").withColumnRenamed(count, "n_replaced")
    after = after.withColumn("n_chars", F.col("n_chars") + grown)
    return after.select(*docs.columns)
