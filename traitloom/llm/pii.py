"""Personal data: candidate spans, gradient-boosted trees over them, redaction. Column functions only.

Four base kinds are found by pattern and checked (parts, digits, Luhn); these always count.
Further generators propose spans that may overlap: bare telephone shapes, spelt-out
addresses, account and national numbers, long numbers. Boosted trees judge these by format
and context. They are fitted on fixed templated spans, personal and not, and on those candidates
from a bounded sample of documents that a check decides (Luhn, ranges, lengths, IBAN digits).
A candidate that no check decides has no label. The bar is set on templated spans kept out of
training, so it does not depend on how much personal data a corpus holds. National and account
numbers also have to pass the check of their kind. The model becomes one column expression.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm.common import cut, text_or_empty

BASE = ("email", "ip", "card", "phone")
EXTRA = ("spelt_email", "local_phone", "account", "national", "number")
KINDS = BASE + EXTRA
SAMPLE_DOCS = 40_000
TREES, DEPTH = 12, 3
FLOOR = 0.5
FORMS = 40  # filled-in texts of each template
BLOCK_BITS, PIECE_BITS = 8, 10  # blocks of running sums, pieces of a text
BLOCK, PIECE = 1 << BLOCK_BITS, 1 << PIECE_BITS
_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive quantifiers and the look-behind keep long runs linear; a run that follows the
# end of the match before may still begin one. Neither changes what matches.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelt_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}",
    "local_phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9](?:[\x20.()/-]?[0-9]){5,31}+(?![0-9])",
}
# A cheap look that every text with a match passes.
GATES = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "spelt_email": r"[\[(](?:at|AT)[\])]", "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "account": r"[A-Z]{2}[0-9]{2}",
    "national": r"-[0-9]{2}-[0-9]{4}", "number": r"[0-9]{2}",
}
_CONTACT = r"(?i)(?:mail|contact|write|reach|call|phone|tel|mobile|fax|whats)"
_ACCOUNT = r"(?i)(?:card|visa|account|iban|ssn|passport|social|tax|bank|born|birth)"
_TECHNICAL = r"(?i)(?:version|release|isbn|issn|doi|page|vol|figure|section|license|licence|key|token|hash|=|0x)"
FEATURES = (
    "size", "digits", "letters", "upper", "signs", "groups", "distinct", "zeros", "left_word", "right_word",
    "left_sign", "contact", "account", "technical", "mail_sign", "plus", "leading", "kind",
)

# Texts around a span, by the kind of span that is personal there ...
_ANY = ("{}", "{} or by post", "| {} |", "Jane Roe, {}, Boston", "the record of Mr Weber: {}", "number: {}.", "we wrote down {} that day")
PERSONAL = {
    "local_phone": (*_ANY, "please call {} today", "phone {}", "Tel. {}", "reach me at {} in the evening", "fax: {}", "my mobile is {}"),
    "spelt_email": (*_ANY, "write to {} for more", "mail {}", "contact: {}", "reach the editor at {}"),
    "account": (*_ANY, "IBAN {}", "IBAN: {}", "pay into account {} by May", "bank details {}"),
    "national": (*_ANY, "SSN {}", "SSN: {}", "social security number {}", "her tax number is {}"),
    "number": (
        "please call {} today", "phone {}", "Tel. {}", "mobile: {}", "account {} at the bank", "account no. {}", "passport {}", "tax number {}",
        "born on {}", "date of birth: born {}", "WhatsApp {}",
    ),
}
# ... and by the kind of span that is not.
OTHER = {
    "number": (
        "version {}", "release {} is out", "ISBN {}", "ISSN {}", "doi {}", "page {}", "vol {}", "key {}", "of key {}", "token {}", "hash=ab{}", "x={}",
        "hash {}", "0x{}", "in total {} units", "on {} it rained", "{} people live there", "a score of {} and more", "figure {}", "section {}", "see {}.", "{}",
    ),
    "local_phone": ("version {}", "release {}", "ISBN {}", "key {}", "token={}", "section {}"),
    "national": ("version {}", "release {}", "ISBN {}", "key {}", "token={}", "section {}"),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op) -> Column:
    """For each place of an array of integers, ``op`` over zero and all values before it.

    Arrays only grow within blocks of ``BLOCK`` values and over the ends of the blocks, so the work is
    all but linear for any text that fits in a row. ``op`` has to be associative.
    """
    def grown(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def joined(parts: Column) -> Column:
        before = grown(F.transform(parts, lambda p: F.element_at(p, -1)))
        placed = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, at: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda v: op(at, v)))
        return F.flatten(placed)

    def run(vs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(vs) - 1, F.lit(0)), BLOCK_BITS))
        return _let(F.transform(starts, lambda b: grown(F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))), joined)

    return _let(values, run)


def _pieces(text: Column) -> Column:
    """The text cut every ``PIECE`` code points, so a place is reached without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def _between(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in pieces; what lies behind its end is empty."""
    first = F.shiftright(begin, PIECE_BITS)
    near = F.array_join(F.slice(pieces, first + 1, F.shiftright(end - 1, PIECE_BITS) - first + 1), "")
    return F.when(end > begin, F.substring(near, begin.bitwiseAND(PIECE - 1) + 1, end - begin)).otherwise(F.lit(""))


def _matches(text: Column, *kinds: str) -> Column:
    """Per kind an array<struct<start, end, value>> of the leftmost matches that do not overlap, in code points."""
    def pairs(kind: str) -> Column:
        gaps, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        # One gap more than hits.
        both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))), lambda p: p["hit"].isNotNull())
        return F.when(text.rlike(GATES[kind]), both).otherwise(F.expr("slice(array(named_struct('gap', 0, 'hit', '')), 1, 0)"))

    def placed(ps: Column) -> Column:
        before = _running(F.transform(ps, lambda p: p["gap"] + F.length(p["hit"])), lambda a, b: a + b)
        return F.zip_with(ps, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["hit"])).alias("end"), p["hit"].alias("value")))

    return F.transform(F.array(*[pairs(k) for k in kinds]), placed)


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    places = F.split(F.reverse(digits), "")

    def weigh(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(places, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def iban(value: Column) -> Column:
    """Whether the check digits of an account number (15 to 34 letters and digits, blanks apart) agree."""
    plain = F.regexp_replace(value, r"\x20", "")
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        return F.pmod(F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55), F.lit(97))

    return F.length(plain).between(15, 34) & (F.aggregate(signs, F.lit(0), step) == 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _checked(kind: str, value: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _refuted(span: Column) -> Column:
    """Whether a candidate fails the check of its kind: ranges of national numbers, check digits of accounts."""
    value = span["value"]
    national = value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(span["kind_no"] == KINDS.index("national"), national).when(span["kind_no"] == KINDS.index("account"), ~iban(value)).otherwise(F.lit(False))


def _trimmed(span: Column) -> Column:
    """An account number without the capital words behind it: the longest run of its groups that checks."""
    groups = F.split(span["value"], r"\x20")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    value = F.coalesce(F.get(F.filter(runs, iban), F.lit(0)), span["value"])
    return F.struct(span["start"].alias("start"), (span["start"] + F.length(value)).alias("end"), value.alias("value"))


def _ordered(spans: list[tuple[int, Column]]) -> Column:
    """One array of struct<kind_no, start, end, value>, by kind, then start."""
    def numbered(k: int):
        return lambda x: F.struct(F.lit(k).alias("kind_no"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))

    return F.array_sort(F.flatten(F.array(*[F.transform(s, numbered(k)) for k, s in spans])))


def base_spans(text: Column) -> Column:
    """Checked spans of the four base kinds."""
    def passing(kind: str):
        return lambda x: _checked(kind, x["value"])

    return _let(_matches(text, *BASE), lambda found: _ordered([(k, F.filter(found[k], passing(kind))) for k, kind in enumerate(BASE)]))


def failed_spans(text: Column) -> Column:
    """Matches of the base kinds with the size of one that fail the check: no address, Luhn or length."""
    def failing(kind: str):
        return lambda x: ~_checked(kind, x["value"]) & (F.length(_digits(x["value"])).between(13, 19) if kind == "card" else F.lit(True))

    return _let(_matches(text, *BASE[1:]), lambda found: _ordered([(k + 1, F.filter(found[k], failing(kind))) for k, kind in enumerate(BASE[1:])]))


def candidate_spans(text: Column) -> Column:
    """Spans of the further generators, with the text beside them; they may overlap one another and the base spans.

    ``before``: up to 24 characters; ``left``, ``right``: the neighbours, a blank and nothing at the ends.
    """
    def listed(found: Column) -> Column:
        return _ordered([(len(BASE) + k, F.transform(found[k], _trimmed) if kind == "account" else found[k]) for k, kind in enumerate(EXTRA)])

    spans = _let(_matches(text, *EXTRA), listed)

    def beside(pieces: Column):
        def of(s: Column) -> Column:
            before = _between(pieces, F.greatest(s["start"] - 24, F.lit(0)), s["start"])
            left = F.when(s["start"] > 0, _between(pieces, s["start"] - 1, s["start"])).otherwise(F.lit(" "))
            right = _between(pieces, s["end"], s["end"] + 1)
            return F.struct(*[s[c].alias(c) for c in ("kind_no", "start", "end", "value")], before.alias("before"), left.alias("left"), right.alias("right"))

        return of

    return _let(spans, lambda ss: _let(F.when(F.size(ss) > 0, _pieces(text)), lambda ps: F.transform(ss, beside(ps))))


def features(span: Column) -> list[Column]:
    """Format, context and kind of a candidate span as doubles, in the order of ``FEATURES``."""
    value, before, left, right = span["value"], span["before"], span["left"], span["right"]
    size = F.length(value)

    def share(what: str) -> Column:
        return (size - F.length(F.regexp_replace(value, what, ""))) / F.greatest(size, F.lit(1))

    digits = _digits(value)
    columns = [
        F.least(size, F.lit(64)), share("[0-9]"), share("[A-Za-z]"), share("[A-Z]"), share(r"[\x20().@+/-]"),
        F.size(F.split(value, r"[\x20().@/-]+")), F.size(F.array_distinct(F.split(digits, ""))), share("0"),
        left.rlike("[A-Za-z0-9_]"), right.rlike("[A-Za-z0-9_]"), left.rlike(r"[=:\"'/#]"),
        before.rlike(_CONTACT), before.rlike(_ACCOUNT), before.rlike(_TECHNICAL),
        value.contains("@"), left.eqNullSafe("+") | value.startswith("+"), value.rlike("^[0-9]{13}"),
        span["kind_no"],
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]


def _by_start(spans: Column) -> Column:
    """The spans by start, the longest first."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind_no"].alias("kind_no"))))


def _ends_before(sorted_spans: Column) -> Column:
    """The furthest end of the spans before each one."""
    return _running(F.transform(sorted_spans, lambda s: -s["back"]), lambda a, b: F.greatest(a, b))


def mask(spans: Column) -> Column:
    """A text as long as the last end, ``x`` where a span lies, blank elsewhere, in pieces."""
    def drawn(ss: Column) -> Column:
        def part(s: Column, at: Column) -> Column:
            begin = F.greatest(s["start"], at)
            return F.concat(F.repeat(F.lit(" "), begin - at), F.repeat(F.lit("x"), F.greatest(-s["back"] - begin, F.lit(0))))

        return _pieces(F.array_join(F.zip_with(ss, _ends_before(ss), part), ""))

    return _let(_by_start(spans), drawn)


def _covered(span: Column, masked: Column) -> Column:
    """Whether a span overlaps one of those that the mask was made of."""
    return _between(masked, span["start"], span["end"]).contains("x")


@dataclass
class Model:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, and the bar to pass."""

    trees: list
    weights: list[float]
    threshold: float

    def score(self, columns: list[Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            k, at, left, right = node
            return F.when(columns[k] <= at, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + walk(tree) * weight
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _read_tree(node) -> float | tuple:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def _account(rng: random.Random) -> str:
    """An account number with right check digits, in groups of four or in one."""
    country, size = rng.choice([("DE", 22), ("GB", 22), ("FR", 27), ("ES", 24), ("NL", 18), ("BE", 16)])
    bank = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) if country in ("GB", "NL") else ""
    rest = bank + "".join(rng.choice("0123456789") for _ in range(size - 4 - len(bank)))
    whole = f"{country}{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}{rest}"
    return " ".join(whole[i : i + 4] for i in range(0, size, 4)) if rng.random() < 0.5 else whole


def _value(rng: random.Random, kind: str, personal: bool) -> str:
    def n(least: int, most: int) -> int:
        return rng.randrange(least, most)

    if kind == "local_phone":
        area, rest = n(200, 1000), f"{n(200, 1000)}{rng.choice('-.')}{n(0, 10000):04d}"
        return rng.choice([f"({area}) {rest}", f"{area}-{rest}", f"{area}.{rest}", f"{area} {rest}"])
    if kind == "national":
        return f"{rng.choice([n(1, 666), n(667, 900)]):03d}-{n(1, 100):02d}-{n(1, 10000):04d}"
    if kind == "account":
        return _account(rng)
    if kind == "spelt_email":
        name = rng.choice(["jane", "j.roe", "info", "max_weber", "anna-l", "editor7", "desk42"])
        host, end = rng.choice(["example", "mail", "uni-ulm", "host3", "paper"]), rng.choice(["org", "com", "de", "co.uk"])
        return rng.choice([f"{name} [at] {host} [dot] {end}", f"{name}(at){host}.{end}", f"{name} (at) {host} (dot) {end}", f"{name}[AT]{host}[DOT]{end}"])
    if personal:
        return rng.choice([
            f"0{n(20, 999)} {n(100000, 10**7)}", f"0{n(10**8, 10**10)}", f"0{n(150, 180)} {n(100, 1000)} {n(1000, 10000)}", f"{n(10**7, 10**10)}",
            f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1930, 2010)}", f"{n(1930, 2010)}-{n(1, 13):02d}-{n(1, 29):02d}",
        ])
    return rng.choice([
        f"{n(10**5, 10**8)}", f"{n(10**8, 10**16)}", f"{n(10**15, 10**16)}", f"978-3-{n(10, 99)}-{n(10**5, 10**6)}-{n(0, 10)}", f"{n(1000, 10**4)}-{n(1000, 10**4)}",
        f"10.{n(1000, 10**4)}/{n(100, 10**6)}", f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 1000)} {n(100, 1000)} {n(100, 1000)}",
        f"{n(1, 10)}.{n(10**5, 10**9)}", f"{n(1, 20)}.{n(0, 60)}.{n(100, 10**5)}", f"{n(1900, 2000)}-{n(2000, 2030)}",
    ])


def templated(spark: SparkSession, forms: int = FORMS, seed: int = 11) -> DataFrame:
    """Rows (text, begin, end, label, held): fixed texts around spans that are personal (1) or not (0).

    The same for every corpus. One in four is ``held`` back from training.
    """
    rng, rows = random.Random(seed), []
    for label, table in ((1.0, PERSONAL), (0.0, OTHER)):
        for kind, frames in table.items():
            for frame in frames:
                for i in range(forms):
                    value = _value(rng, kind, label > 0)
                    at = frame.index("{}")
                    rows.append({"text": frame.replace("{}", value), "begin": at, "end": at + len(value), "label": label, "held": i % 4 == 3})
    kind_of = "array<struct<text: string, begin: int, end: int, label: double, held: boolean>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind_of)).alias("r")).select("r.*")


def _sampled(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """span, label of the candidates that a check decides, in about ``sample_docs`` documents chosen by a hash of the id."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    chance = F.pmod(F.xxhash64(F.lit("pii"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    text = F.col("text")
    rows = docs.where(chance < share).select(text_or_empty(text_col).alias("text"))

    def labelled(good: Column, bad: Column) -> Column:
        def label(s: Column) -> Column:
            sure = (s["kind_no"] == KINDS.index("account")) & ~_refuted(s)
            return F.when(sure | _covered(s, good), 1.0).when(_refuted(s) | _covered(s, bad), 0.0)

        return F.transform("more", lambda s: F.struct(s.alias("span"), label(s).alias("label")))

    rows = rows.select("text", base_spans(text).alias("passed"), failed_spans(text).alias("failed"))
    rows = rows.select(mask(F.col("passed")).alias("good"), mask(F.col("failed")).alias("bad"), candidate_spans(text).alias("more"))
    spans = _let(F.col("good"), lambda good: _let(F.col("bad"), lambda bad: labelled(good, bad)))
    rows = rows.select(F.explode(spans).alias("one")).select("one.span", "one.label")
    return rows.where(F.col("label").isNotNull())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trees fitted on templated spans and on the decided candidates of at most about ``sample_docs`` documents.

    Label 1: a candidate around a personal templated span, over a base span that passed its check, or
    an account with right check digits. Label 0: a candidate around another templated span, over a
    match that failed its check, or out of range. The others have no label and no say. Documents weigh
    as much as the templates at most, and need not have either label. The bar, one half at least, is
    where held-back templated spans are told apart best.
    """
    made = templated(docs.sparkSession).withColumn("span", F.explode(candidate_spans(F.col("text"))))
    made = made.where((F.col("span.start") <= F.col("begin")) & (F.col("span.end") >= F.col("end"))).where(~_refuted(F.col("span")))
    made = made.select("span", "label", "held", F.lit(True).alias("made"))
    seen = _sampled(docs, id_col, text_col, sample_docs).select("span", "label", F.lit(False).alias("held"), F.lit(False).alias("made"))
    named = [c.alias(n) for n, c in zip(FEATURES, features(F.col("span")))]
    table = cut(made.unionByName(seen).select("label", "held", "made", *named))
    sizes = {r["made"]: r["count"] for r in table.where("not held").groupBy("made").count().collect()}
    weight = min(1.0, sizes[True] / sizes.get(False, sizes[True]))
    train = table.where("not held").withColumn("weight", F.when(F.col("made"), 1.0).otherwise(weight))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, weightCol="weight").fit(vectors)
    model = Model([_read_tree(t._java_obj.rootNode()) for t in fitted.trees], list(fitted.treeWeights), FLOOR)
    # Scores to a thousandth, so what comes back has a fixed bound.
    scored = table.where("held").select("label", F.floor(model.score([F.col(n) for n in FEATURES]) * 1000).alias("s"))
    counts = scored.groupBy("s").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")).collect()
    ones, zeros = sum(r["ones"] for r in counts), sum(r["zeros"] for r in counts)

    def told_apart(bar: int) -> float:
        above = [r for r in counts if r["s"] >= bar]
        return sum(r["ones"] for r in above) / ones - sum(r["zeros"] for r in above) / zeros

    least = int(FLOOR * 1000)
    model.threshold = max([least, *sorted(int(r["s"]) for r in counts if r["s"] > least)], key=told_apart) / 1000
    return model


def find(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns with ``pii_spans``: array<struct<kind_no, start, end, value>> in whole texts.

    Base spans first, by kind and start, then the candidates at or above the threshold that touch no
    base span and do not fail the check of their kind. Null and empty text have none. An earlier column of that name goes.
    """
    text = text_or_empty(text_col)
    found = docs.drop("pii_spans").withColumn("__base", base_spans(text))
    if model is None:
        return found.withColumnRenamed("__base", "pii_spans")

    def kept(masked: Column) -> Column:
        return F.filter("__more", lambda s: ~_covered(s, masked) & ~_refuted(s) & (model.score(features(s)) >= model.threshold))

    # The mask is bound by ``_let``: alone, its expression would be put into the filter and drawn for each span.
    found = found.withColumn("__mask", mask(F.col("__base"))).withColumn("__more", candidate_spans(text))
    more = F.transform(_let(F.col("__mask"), kept), lambda s: F.struct(*[s[c].alias(c) for c in ("kind_no", "start", "end", "value")]))
    return found.withColumn("pii_spans", F.concat("__base", more)).drop("__base", "__mask", "__more")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of each base kind, base_sha256 and ``spans`` (kind:start:end, joined)."""
    model = fit(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find(rows, model)
    base = F.filter("pii_spans", lambda s: s["kind_no"] < len(BASE))

    def of_kind(k: int):
        return lambda s: s["kind_no"] == k

    counts = [F.size(F.filter("pii_spans", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """Text with each stretch of overlapping spans replaced by the kind of its first span."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def rest(pieces: Column, ss: Column) -> Column:
        def part(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(_between(pieces, at, s["start"]), F.get(names, s["kind_no"]))).otherwise(F.lit(""))

        last = F.aggregate(ss, F.lit(0), lambda a, s: F.greatest(a, -s["back"]))
        return F.concat(F.array_join(F.zip_with(ss, _ends_before(ss), part), ""), _let(last, lambda at: _between(pieces, at, F.length(text))))

    whole = _let(_by_start(spans), lambda ss: _let(_pieces(text), lambda ps: rest(ps, ss)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced; ``length_col``, if there, follows the new text."""
    found = find(docs, fit(docs, id_col, text_col), text_col)
    text = F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), F.col("pii_spans")))
    out = found.withColumn(text_col, text)
    if length_col in docs.columns:
        changed = F.size("pii_spans") > 0
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
