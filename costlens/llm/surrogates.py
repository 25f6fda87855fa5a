"""PII surrogates (DataFrame and SQL functions only).

Entities are found by patterns: e-mail addresses, IPv4 addresses, payment cards, social security numbers, phone numbers,
bank account numbers, access tokens, and names after a form of address.  A document that gives a name so has the name's
words known: they are found in the rest of it without a form of address too, alone or in twos.  Every distinct entity of
the corpus gets one surrogate, made from SHA-256 of a secret key, its type and its canonical form, so that it is the same
wherever the entity occurs (coreference: a canonical form has no case or separators; the parts of a name and the domain
of an address are entities of their own; a given name is one entity whatever the form of address).  Surrogates keep type,
length and format: digits for digits, letters of the same script and case for letters, separators in place, a phone's
country code, valid check digits of cards and bank accounts for valid ones, private and loopback addresses as such and
the length of every number in an address.  Names keep script and case; a given name has the gender that its forms of
address tell (male before female where they differ).

Distinctness: surrogates of one type are compared with one another and with all originals of that type; of several
entities with one surrogate only the first keeps it, and what equals an original goes too.  The others are drawn again
until nothing collides.  Where the values of a length run out (or nothing in a part can change, as in ``__@x.org``)
surrogates grow: e-mails, domains, secrets and names of the same type by letters after a few attempts, numbers of a fixed
format only after many.  So a free value always exists, and no corpus is given up.

Text is replaced by cutting it at the mentions and joining the parts with the surrogates between them.  Surrogates
depend on the mention alone, so the tables joined are keyed by mention and by text digest, and copies are folded before.

Defined results: a null text counts as empty; a text without entities comes back unchanged; every row has its row in
the result, also where ids repeat or are null."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens.llm.common import id_text, looked_up, saved

#: Forms of address with the gender they tell - fixed values.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor")
_TITLES = (*MALE, *FEMALE, *NEUTRAL)
_TITLE = "|".join(dict.fromkeys((*_TITLES, *(t.upper() for t in _TITLES))))
#: A word of a name; what follows an apostrophe or a hyphen belongs to it if it is a capital and more letters.
_WORD = r"\p{Lu}\p{L}*+(?:['\u2019-]\p{Lu}\p{L}++)*+"
#: type -> pattern; where several match at one place the first wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?<![\d+])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<![\d\p{L}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_WORD}(?: {_WORD})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Letters that stand in for letters of a script, and syllables of made-up names - fixed values.
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: First and last code point of letters that stand in for those of a further script, at most 256 of each - fixed values.
#: Letters of scripts not listed become Latin ones, digits and numerals that are not ASCII become ASCII digits.
_RANGES = {
    "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x641, 0x64A), "Armenian": (0x561, 0x586), "Georgian": (0x10D0, 0x10F0), "Syriac": (0x712, 0x72C),
    "Thaana": (0x780, 0x7A5), "Devanagari": (0x905, 0x939), "Bengali": (0x995, 0x9B9), "Gurmukhi": (0xA15, 0xA39), "Gujarati": (0xA95, 0xAB9),
    "Oriya": (0xB15, 0xB39), "Tamil": (0xB95, 0xBB9), "Telugu": (0xC15, 0xC39), "Kannada": (0xC95, 0xCB9), "Malayalam": (0xD15, 0xD39),
    "Sinhala": (0xD9A, 0xDC6), "Thai": (0xE01, 0xE2E), "Lao": (0xE94, 0xEAE), "Tibetan": (0xF40, 0xF68), "Myanmar": (0x1000, 0x1021),
    "Ethiopic": (0x1200, 0x1247), "Cherokee": (0xAB70, 0xABBF), "Khmer": (0x1780, 0x17A2), "Mongolian": (0x1820, 0x1842),
    "Hiragana": (0x304B, 0x3082), "Katakana": (0x30AB, 0x30E2), "Bopomofo": (0x3105, 0x3129), "Hangul": (0xAC00, 0xACFF), "Han": (0x4E00, 0x4EFF),
}
_FURTHER = {script: "".join(c for c in map(chr, range(a, b + 1)) if c.isalpha()) for script, (a, b) in _RANGES.items()}
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе бо да де ди до га ге ка ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви за".split(),
}
_END = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "u"): "l", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", "u"): "л"}
#: Country codes of phone numbers, and addresses that are not public: what of them stays - fixed values.
_COUNTRY = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
_KEPT = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(?=(?:1[6-9]|2\d|3[01])\.))"
#: Attempts at one length, and at the length of a number whose format is fixed (longer ones leave the format).
TRIES, FIXED_TRIES = 4, 20


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def known_words(found: Column) -> Column:
    """Words of the names among a document's mentions, longest first."""
    names = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    words = F.array_distinct(F.flatten(F.transform(names, lambda m: F.slice(F.split(m, " "), 2, 2))))
    return F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), lambda x: x["w"])


def document_pattern(words: Column) -> Column:
    """``PATTERN``, and a document's known words, one or two in a row."""
    one = F.concat(F.lit("(?:"), F.array_join(words, "|"), F.lit(")"))
    bare = F.concat(F.lit(r"|(?<![\p{L}\p{N}])"), one, F.lit("(?: "), one, F.lit(r")?(?![\p{L}\p{N}])"))
    return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN), bare)).otherwise(F.lit(PATTERN))


def kind_of(mention: Column) -> Column:
    """The kind of a mention; ``bare``: words of a name without a form of address."""
    out = F.lit("bare")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def parts(found: DataFrame) -> DataFrame:
    """mention, kind, n (order of the part), type, canon, gender: the entities that a mention is made of."""
    m, kind = F.col("mention"), F.col("kind")
    low = F.lower(m)
    title = F.upper(F.regexp_extract(m, rf"^({_TITLE})\.? ", 1))
    upper = lambda titles: [t.upper() for t in titles]
    gender = F.when(title.isin(*upper(MALE)), "1m").when(title.isin(*upper(FEMALE)), "2f").otherwise("3u")
    words = F.slice(F.split(m, " "), 2, 2)
    one = lambda type_, canon, gender=F.lit("3u"): F.struct(type_.alias("type"), canon.alias("canon"), gender.alias("gender"))
    none = F.array().cast("array<struct<type:string,canon:string,gender:string>>")
    given = F.when(F.size(words) == 2, F.array(one(F.concat_ws(".", F.lit("given"), _script(words[0])), F.lower(words[0]), gender))).otherwise(none)
    last = F.element_at(words, -1)
    name = F.concat(given, F.array(one(F.concat_ws(".", F.lit("surname"), _script(last)), F.lower(last))))
    both = (
        F.when(kind == "email", F.array(one(F.lit("email"), low), one(F.lit("domain"), F.substring_index(low, "@", -1))))
        .when(kind == "name", name)
        .when(kind.isin("card", "ssn", "phone"), F.array(one(kind, F.regexp_replace(m, r"[^0-9+]", ""))))
        .when(kind == "iban", F.array(one(kind, F.replace(m, F.lit(" "), F.lit("")))))
        .otherwise(F.array(one(kind, m)))
    )
    columns = ["mention", "kind", "n", "part.type", "part.canon", "part.gender"]
    titled = found.filter(kind != "bare").select("mention", "kind", F.posexplode(both).alias("n", "part")).select(*columns)
    # a bare word is what the corpus' forms of address say: a surname if it ever is one, first of two a given name if it is
    role = F.substring_index("type", ".", 1)
    roles = titled.filter(kind == "name").groupBy(F.col("canon").alias("_word")).agg(F.max(role == "given").alias("_given"), F.max(role == "surname").alias("_surname"))
    bare = found.filter(kind == "bare").select("mention", "kind", F.size(F.split(m, " ")).alias("_many"), F.posexplode(F.split(m, " ")).alias("n", "_w"))
    bare = bare.join(roles, F.lower("_w") == F.col("_word"))
    first = F.col("_given") & ((F.col("_many") == 2) & (F.col("n") == 0) | ~F.col("_surname"))
    kind_of_word = F.concat_ws(".", F.when(first, "given").otherwise("surname"), _script(F.col("_w")))
    return titled.unionByName(bare.select("mention", "kind", "n", kind_of_word.alias("type"), F.col("_word").alias("canon"), F.lit("3u").alias("gender")))


def _stream(key: str, attempt: int) -> Column:
    """256 hexadecimal digits that only the key's holder can make."""
    seed = [F.lit(key), F.col("type"), F.col("canon"), F.lit(str(attempt))]
    return F.concat(*[F.sha2(F.concat_ws("\x1f", *seed, F.lit(str(i))), 256) for i in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))


def shaped(text: Column, stream: Column, hexadecimal: bool = False, ascii_only: bool = True) -> Column:
    """Every letter or digit for one of its kind, everything else in place (``ascii_only``: the text has no others)."""
    small = "abcdef" if hexadecimal else _LATIN

    def further(c: Column, b: Column) -> Column:
        out = F.when(c.rlike(r"\p{L}"), _pick(_LATIN, b)).when(c.rlike(r"\p{N}"), _pick("0123456789", b)).otherwise(c)
        for script, letters in _FURTHER.items():
            out = F.when(c.rlike(rf"[\p{{L}}&&\p{{Is{script}}}]"), _pick(letters, b)).otherwise(out)
        return out

    def swap(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        plain = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[a-z]"), _pick(small, b))
            .when(c.rlike("[A-Z]"), _pick(small.upper(), b))
        )
        if ascii_only:
            return plain.otherwise(c)
        return (
            plain.when(c.rlike(r"\p{ASCII}"), c)
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c == F.lower(c), _pick(_CYRILLIC, b)).otherwise(F.upper(_pick(_CYRILLIC, b))))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c == F.lower(c), _pick(_GREEK, b)).otherwise(F.upper(_pick(_GREEK, b))))
            .when(c.rlike(r"\p{IsLatin}"), F.when(c == F.lower(c), _pick("áéíóúàèìòùäëïöü", b)).otherwise(_pick("ÁÉÍÓÚÀÈÌÒÙÄËÏÖÜ", b)))
            .otherwise(further(c, b))
        )

    return F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), swap))


def _more(stream: Column, letters: str, n: int) -> Column:
    """``n`` letters, from the end of the stream."""
    return F.concat(F.lit(""), *[_pick(letters, _byte(stream, F.lit(127 - i))) for i in range(n)])


def grown(text: Column, stream: Column, attempt: int, ascii_only: bool = True) -> Column:
    """``shaped``, and longer by letters from attempt ``TRIES`` on, or at once where nothing can change."""
    n = attempt // TRIES
    fixed = ~text.rlike(r"[\p{L}\p{N}]")
    return F.concat(shaped(text, stream, ascii_only=ascii_only), F.when(fixed, _more(stream, _LATIN, n + 1)).otherwise(_more(stream, _LATIN, n)))


def _luhn(digits: Column, doubled_from: int) -> Column:
    """Sum of the digits, every second one from the right doubled; ``doubled_from`` 0: the last one is doubled."""
    array = F.reverse(F.regexp_extract_all(digits, F.lit("."), F.lit(0)))
    value = F.transform(array, lambda c, i: F.when(i % 2 == doubled_from, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """A bank account's digits and letters (10 to 35), four first ones last, modulo 97."""
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step)


def _address(canon: Column, stream: Column, attempt: int) -> Column:
    """An IPv4 address of the same class; every number as long as it was, from attempt ``TRIES`` on of any length, from
    ``FIXED_TRIES`` on with more parts."""
    kept = F.regexp_extract(canon, _KEPT, 1)
    parts, before = F.split(canon, r"\."), F.size(F.split(kept, r"\.")) - 1
    any_ = lambda b: (b % 254 + 1).cast("string")

    def part(i: int) -> Column:
        b, old = _byte(stream, F.lit(i)), F.get(parts, F.lit(i))
        alike = F.when(F.length(old) == 1, (b % 9 + 1).cast("string")).when(F.length(old) == 2, (b % 90 + 10).cast("string")).otherwise((b % 156 + 100).cast("string"))
        new = alike if attempt < TRIES else any_(b)
        if i == 1:
            new = F.when(kept == "172.", (b % 16 + 16).cast("string")).otherwise(new)
        return F.when(F.lit(i) < before, old).otherwise(new)

    return F.concat_ws(".", *[part(i) for i in range(4)], *[any_(_byte(stream, F.lit(4 + i))) for i in range(attempt // FIXED_TRIES)])


def surrogate(key: str, attempt: int) -> Column:
    """The surrogate of (type, canon, gender) at the given attempt."""
    type_, canon, stream = F.col("type"), F.col("canon"), _stream(key, attempt)
    extra = attempt // FIXED_TRIES
    number = F.concat(shaped(canon, stream), _more(stream, "0123456789", extra))
    card = F.concat(F.substring(canon, 1, 1), F.substring(number, F.lit(2), F.length(number) - 2))
    card = F.when(_luhn(canon, 1) % 10 == 0, F.concat(card, (F.lit(10) - _luhn(card, 0) % 10) % 10)).otherwise(F.concat(card, F.substring(number, -1, 1)))
    country = F.regexp_extract(canon, _COUNTRY, 1)
    phone = F.concat(country, F.substring(number, F.length(country) + 1, F.length(number)))
    ip = _address(canon, stream, attempt)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(canon, ".", -1)
    part = F.when(type_ == "email", local).otherwise(F.substring(canon, F.lit(1), F.length(canon) - F.length(top) - 1))
    part = grown(part, stream, attempt, ascii_only=False)  # of both types in one, as the plan of it is large
    email, site = F.concat(part, F.lit("@"), domain), F.concat(part, F.lit("."), top)
    iban = F.concat(F.substring(canon, 1, 2), shaped(F.substring(canon, F.lit(3), F.length(canon)), stream), _more(stream, "0123456789", extra))
    open_check = F.concat(F.substring(iban, 1, 2), F.lit("00"), F.substring(iban, F.lit(5), F.length(iban)))
    valid = F.concat(F.substring(iban, 1, 2), F.lpad((98 - _mod97(open_check)).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.length(iban)))
    iban = F.when((type_ == "iban") & (_mod97(canon) == 1), valid).otherwise(iban)
    prefix = F.regexp_extract(canon, r"^(AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_-])", 1)
    secret = F.when(canon.rlike("^[0-9a-fA-F]+$"), F.concat(shaped(canon, stream, True), _more(stream, "0123456789", extra))).otherwise(
        F.concat(prefix, grown(F.substring(canon, F.length(prefix) + 1, F.length(canon)), stream, attempt))
    )
    many = 2 + attempt // TRIES  # longer names where the short ones run out
    name = F.lit("")
    for (script, gender), end in _END.items():
        table = F.array(*map(F.lit, _SYLLABLES[script]))
        made = F.concat(*[F.element_at(table, _byte(stream, F.lit(i)) % len(_SYLLABLES[script]) + 1) for i in range(many + 1)], F.lit(end))
        name = F.when(type_.endswith(script) & F.col("gender").endswith(gender), made).otherwise(name)
    return (
        F.when(type_ == "email", email).when(type_ == "domain", site).when(type_ == "card", card).when(type_ == "ip", ip)
        .when(type_ == "phone", phone).when(type_ == "iban", iban).when(type_ == "secret", secret)
        .when(type_ == "ssn", number).otherwise(name)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """type, canon, surrogate of the distinct ``entities`` (type, canon, gender; the first gender counts): within a type no
    two share a surrogate, and none is an original."""
    entities = saved(entities.groupBy("type", "canon").agg(F.min("gender").alias("gender")), "surrogate-entities")
    taken, pending = None, entities
    for attempt in count():  # ends: the values to draw from grow with the attempts, the entities do not
        drawn = saved(pending.select("type", "canon", "gender", surrogate(key, attempt).alias("surrogate")), "surrogate-drawn")
        first = drawn.groupBy("type", "surrogate").agg(F.min("canon").alias("canon"))
        originals = entities.select("type", F.col("canon").alias("surrogate"))
        free = first.join(originals, ["type", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["type", "surrogate"], "left_anti")
        free = free.select("type", "canon", "surrogate")
        taken = saved(free if taken is None else taken.unionByName(free), "surrogate-taken")
        pending = saved(pending.join(taken, ["type", "canon"], "left_anti"), "surrogate-pending")
        if pending.isEmpty():
            return taken


def rendered(made: DataFrame) -> DataFrame:
    """mention, surrogate: the parts of a mention put into its format."""
    m = F.col("mention")
    listed = made.groupBy("mention", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    s = F.col("s")
    email = F.concat(F.substring_index(s[0], "@", 1), F.lit("@"), s[1])
    # capitals where the mention has them
    email = F.when(m == F.lower(m), email).otherwise(
        F.concat_ws("", F.transform(F.regexp_extract_all(email, F.lit("(?s)."), F.lit(0)), lambda c, i: F.when(F.substring(m, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)))
    )
    fill = lambda pattern: F.aggregate(
        F.regexp_extract_all(m, F.lit("(?s)."), F.lit(0)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["out"], F.substring(s[0], a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(s[0], a["at"], F.length(s[0]))),
    )
    kind = F.col("kind")
    words = F.when(kind == "bare", F.split(m, " ")).otherwise(F.slice(F.split(m, " "), 2, 2))
    loud = lambda i: words[i].rlike(r"^\P{Ll}{2,}$")
    name = F.concat_ws(" ", F.transform(s, lambda w, i: F.when(loud(i), F.upper(w)).otherwise(F.initcap(w))))
    out = (
        F.when(kind == "email", email).when(kind == "bare", name).when(kind == "name", F.concat_ws(" ", F.substring_index(m, " ", 1), name))
        .when(kind.isin("card", "ssn", "phone"), fill("[0-9+]")).when(kind == "iban", fill("[A-Z0-9]")).otherwise(s[0])
    )
    return listed.select("mention", out.alias("surrogate"))


def replacements(texts: DataFrame, key: str) -> DataFrame:
    """mention, surrogate of every distinct mention in ``texts`` (mentions array)."""
    found = texts.select(F.explode("mentions").alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention")))
    split = saved(parts(found), "surrogate-parts")
    return saved(rendered(split.join(assign(split, key), ["type", "canon"])), "surrogate-mentions")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates in place of entities, n_entities (mentions replaced) for every row of ``docs``."""
    texts = id_text(docs).withColumn("mentions", mentions(F.col("text")))
    private = texts.filter(F.size("mentions") > 0).withColumn("pattern", document_pattern(known_words(F.col("mentions"))))
    again = F.when(F.length("pattern") > len(PATTERN), F.regexp_extract_all(F.col("text"), F.col("pattern"), F.lit(0))).otherwise(F.col("mentions"))
    private = saved(private.withColumn("mentions", again).withColumn("h", F.xxhash64("text")), "surrogate-private")
    table = replacements(private, key)
    # maps of texts whose hashes agree hold the mentions of both, which changes neither
    wanted = private.select("h", F.explode("mentions").alias("mention")).distinct()
    many = wanted.groupBy("mention").agg(F.count(F.lit(1)).alias("many"))
    counted = saved(table.join(many.hint("shuffle_hash"), "mention"), "surrogate-counted")
    found = looked_up(wanted, counted, "mention", "many", F.col("h"))
    maps = found.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("mention", "surrogate"))).alias("by"))
    between = F.split("text", F.col("pattern"), -1)
    joined = F.concat_ws("", F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.col("by")[F.get("mentions", i)], F.lit("")))))
    replaced = private.join(maps, "h").select("doc_id", joined.alias("text"), F.size("mentions").cast("long").alias("n_entities"))
    clean = texts.filter(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    return clean.unionByName(replaced)
