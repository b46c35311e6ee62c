"""Personal data (operator 6) by weak supervision, with DataFrame and SQL functions only.

1. Candidates: matches of the base kinds (e-mail, IP address, card, phone) and of further kinds (social security and local phone
   numbers, names), with positions. The pieces between matches and the matches themselves add up to the positions.
2. Labelers vote on every candidate: 1 personal, -1 not, 0 abstain. They look at the form (regular expressions), at word lists
   (gazetteers), at the words before, and at the characters around.
3. Expectation-maximisation over the counts of vote patterns (at most 3 ** 5 rows a kind) estimates for each kind the labelers'
   reliabilities and the share of personal data; a pattern's posterior becomes its soft label. Each rate is held by its start as
   if a twentieth of the kind's candidates had confirmed it, so that a table in which nearly all votes agree keeps a meaning of
   personal and other.
4. A logistic regression over kind, votes and form is trained on the soft labels: on the kind's patterns, all kinds alike, and on
   decoys, every possible pattern of votes with a small weight, as a table may hold next to no contrary ones. It decides
   on the further kinds; valid matches of the base kinds stay whatever it says.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.common import written

BASE = ("email", "ip", "card", "phone")
# Word lists of the gazetteer and context labelers.
GIVEN_NAMES = (
    "James Mary John Linda Robert Susan Michael Karen David Sarah Thomas Anna Peter Maria Paul Julia Jean Marie Pierre Claire Hans Ursula Klaus Petra Carlos Carmen Juan Lucia "
    "William Emma Daniel Laura Mark Emily George Alice Charles Helen Joseph Ruth Andrew Jane Simon Kate Martin Eva Stefan Sabine Wolfgang Monika Jürgen Heike Andreas Sophie Luc Camille "
    "François Isabelle Antonio Isabel José Pilar Marco Giulia Luca Francesca Giovanni Paola Olga Ivan Natalia Dmitri Elena Sergei Tatiana Yuki Hiroshi Wei Li Mei Ahmed Fatima Mohammed Aisha "
    "Omar Leila Raj Priya Arjun Anita Lars Ingrid Erik Astrid Jan Katarzyna Piotr Agnieszka"
).split()
NO_GIVEN_NAMES = (
    "The This That These Those A An In On At To By For From And Or But If When Then With Our My Your His Her Their We You He She It They Dear Hello Hi Contact Call Ask Name Names Patient Client Customer "
    "Employee Mail Write Visit See Meet New Old North South East West Great Saint San Los Las United Central Upper Lower Grand Royal National General Chapter Section Page Figure Table Monday Tuesday Wednesday "
    "Thursday Friday Saturday Sunday January February March April May June July August September October November December"
).split()
NO_FAMILY_NAMES = (
    "Street Road Avenue Lane Square Park Bridge River Lake Mountain Valley Island City Town County State States Kingdom Republic University College School Institute Hospital Museum Library Church Company "
    "Corporation Group Bank Inc Ltd Team Committee Department Office Agency Court Council House Street War Day Week Year Report Release Version Edition Award Cup League Union Station Airport"
).split()
MAIL_HOSTS = "gmail yahoo outlook hotmail icloud proton gmx web aol orange free".split()
PERSONAL_WORDS = "mail email e-mail contact call phone tel telephone mobile cell fax card visa mastercard credit payment ip host client customer patient employee address name born ssn social security signed from dear".split()
OTHER_WORDS = "version release build isbn order invoice sku part serial chapter section page figure table article item model batch lot ticket reference ref tracking case volume product".split()

#: Patterns by kind, and what a text has to hold for one. Possessive loops need no stack, and a match of e-mail or IP begins
#: where its run of characters begins or where the match before ended, so long runs without a match take linear time.
_MAIL = r"[A-Za-z0-9._%+-]"
PATTERNS: dict[str, tuple[str, str]] = {
    "email": (rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "text like '%@%'"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text rlike '[0-9]\\.[0-9]'"),
    "card": (r"[0-9](?:[\x20-]?+[0-9]){11,}+", r"text rlike '[0-9](?:[\\x20-]?+[0-9]){11}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"text rlike '\\+[0-9]'"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "text rlike '[0-9]-[0-9]{2}-[0-9]'"),
    "local": (r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20.-]\(?)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "text rlike '[0-9]{3}[.-][0-9]{4}'"),
    "name": (
        rf"(?<!\p{{L}})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?+|(?!(?:Mr|Mrs|Ms|Dr|Prof|{'|'.join(NO_GIVEN_NAMES)})\x20)\p{{Lu}}\p{{Ll}}++\x20\p{{Lu}}\p{{Ll}}++)",
        r"text rlike '\\p{Ll}[.]? \\p{Lu}\\p{Ll}'",
    ),
}
KINDS = tuple(PATTERNS)
LABELERS = ("form", "gazetteer", "context", "repetition", "border")
#: Further features of a span; the decoys have them as often as not.
FORMS = ("long", "separated")
FEATURES = (*(f"is_{k}" for k in KINDS), *(f"{v}_{x}" for v in LABELERS for x in ("yes", "no")), *FORMS)
#: Where the estimate of a labeler starts: how often it votes 1 on personal data and -1 on other, where it votes. A form that
#: holds, digits that differ and free borders say little, the contrary much.
STARTS = {"form": (0.95, 0.5), "gazetteer": (0.9, 0.9), "context": (0.9, 0.9), "repetition": (0.98, 0.1), "border": (0.98, 0.1)}
SHARES = {"name": 0.2, "ssn": 0.5, "local": 0.5} | {k: 0.8 for k in BASE}
ANCHOR = 0.05
DECOYS = 0.5
ROUNDS = 12
_SPAN = "struct<kind: string, start: int, end: int, word: string, before: string, after: string>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positions(kind: str) -> str:
    """Matches m_kind and the pieces p_kind between them as spans, in one walk over both."""
    m, p = f"m_{kind}", f"p_{kind}"
    return f"""CASE WHEN size({m}) > 0 THEN aggregate(sequence(0, size({m}) - 1),
        named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)),
        (a, i) -> named_struct('at', a.at + length({p}[i]) + length({m}[i]), 'out', concat(a.out, array(named_struct(
            'kind', '{kind}', 'start', a.at + length({p}[i]), 'end', a.at + length({p}[i]) + length({m}[i]),
            'word', {m}[i], 'before', lower(right({p}[i], 40)), 'after', left({p}[i + 1], 1))))),
        a -> a.out) ELSE cast(array() AS array<{_SPAN}>) END"""


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add), F.lit(10)) == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(s: Column) -> Column:
    """Whether a match of a base kind is one; all matches of the further kinds are candidates."""
    digits = F.regexp_replace(s["word"], "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(s["kind"] == "ip", s["word"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(s["kind"] == "card", F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False))
        .when(s["kind"] == "phone", (n >= 9) & (n <= 15))
        .otherwise(True)
    )


def _words(words: list[str]) -> str:
    return rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"


def _judged(s: Column) -> Column:
    """Votes and features of one candidate."""
    word, low = s["word"], F.lower(s["word"])
    digits = F.regexp_replace(word, "[^0-9]", "")
    personal, other = s["before"].rlike(_words(PERSONAL_WORDS)), s["before"].rlike(_words(OTHER_WORDS))
    embedded = s["after"].rlike("[A-Za-z0-9_]") | s["before"].rlike("[a-z0-9_]$")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, -1).when(yes, 1).otherwise(0)

    form = (
        F.when(s["kind"] == "email", vote(low.rlike(r"\.[a-z]{2,}$"), ~low.rlike(r"\.[a-z]{2,}$")))
        .when(s["kind"] == "ip", vote(~word.rlike(r"^0"), word.rlike(r"^0")))
        .when(s["kind"] == "ssn", vote(F.lit(True), word.rlike(r"^(?:000|666|9)|-00-|-0000$")))
        .when(s["kind"] == "local", vote(word.rlike(r"^\(?[2-9][0-9]{2}[^0-9]{1,2}[2-9]"), ~word.rlike(r"^\(?[2-9][0-9]{2}[^0-9]{1,2}[2-9]")))
        .when(s["kind"] == "name", vote(word.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)[. ]"), F.lit(False)))
        .otherwise(1)
    )
    known = (
        F.when(s["kind"] == "email", vote(low.rlike(rf"@(?:{'|'.join(MAIL_HOSTS)})\."), low.rlike(r"^(?:no-?reply|info|admin)@")))
        .when(s["kind"] == "name", vote(word.rlike(rf"(?:^|\s)(?:{'|'.join(GIVEN_NAMES)})\s"), word.rlike(rf"\s(?:{'|'.join(NO_FAMILY_NAMES)})$")))
        .when(s["kind"] == "ssn", vote(F.lit(False), word.isin("078-05-1120", "123-45-6789", "219-09-9999")))
        .when(s["kind"] == "local", vote(F.lit(False), word.rlike(r"^\(?(?:800|833|844|855|866|877|888|900)")))
        .otherwise(0)
    )
    same = digits.rlike(r"^([0-9])\1*$")
    return F.struct(
        s["kind"], s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"),
        form.alias("form"), known.alias("gazetteer"), vote(personal & ~other, other & ~personal).alias("context"),
        F.when(F.length(digits) < 8, 0).otherwise(vote(~same, same)).alias("repetition"), vote(~embedded, embedded).alias("border"),
        (F.length(word) >= 16).cast("int").alias("long"), word.rlike("[ ().-]").cast("int").alias("separated"),
    )


def _features(s: Callable[[str], Column]) -> dict[str, Column]:
    """The classifier's features by name, from the columns or fields of a candidate."""
    votes = {f"{v}_{x}": (s(v) == n) for v in LABELERS for x, n in (("yes", 1), ("no", -1))}
    out = {f"is_{k}": s("kind") == k for k in KINDS} | votes | {f: s(f) == 1 for f in FORMS}
    return {name: c.cast("double") for name, c in out.items()}


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found array<struct>): the valid candidates of every row by start and kind, with votes and features."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    for kind, (pattern, sign) in PATTERNS.items():
        quoted = _quoted(pattern)
        rows = rows.withColumns({
            f"m_{kind}": F.expr(f"CASE WHEN {sign} THEN regexp_extract_all(text, {quoted}, 0) ELSE cast(array() AS array<string>) END"),
            f"p_{kind}": F.expr(f"CASE WHEN {sign} THEN split(text, {quoted}, -1) ELSE cast(array() AS array<string>) END"),
        })
    rows = rows.select("id", F.expr(f"concat({', '.join(_positions(k) for k in KINDS)})").alias("s"))
    rows = rows.select("id", F.transform(F.filter("s", _valid), _judged).alias("s"))
    order = F.transform("s", lambda x: F.struct(x["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("rank"), x.alias("span")))
    return rows.select(F.col("id").alias(key), F.transform(F.sort_array(order), lambda x: x["span"]).alias("found"))


Rates = dict[str, tuple[float, dict[str, tuple[float, float]]]]


def reliabilities(patterns: DataFrame) -> Rates:
    """For each kind the share of personal data, and for each labeler how often it votes 1 on personal data and -1 on other,
    by expectation-maximisation over (kind, votes, n). A round is one aggregation of a table of at most 3 ** 5 rows a kind.

    Every rate is a mean with its start, which weighs ``ANCHOR`` of the kind's candidates. A kind without any keeps its start.
    """
    rates: Rates = {k: (SHARES[k], dict(STARTS)) for k in KINDS}
    for _ in range(ROUNDS):
        p = F.col("p")
        sums = [F.sum(F.col("n") * p).alias("personal"), F.sum("n").alias("all")]
        for v in LABELERS:
            sums += [F.sum(F.when(F.col(v) == x, F.col("n") * q).otherwise(0.0)).alias(f"{v}_{a}{b}") for x, a in ((1, "y"), (-1, "n")) for q, b in ((p, "p"), (1 - p, "o"))]
        for row in patterns.withColumn("p", posterior(rates)).groupBy("kind").agg(*sums).collect():  # a row a kind
            held = ANCHOR * row["all"] + 1
            mean = lambda part, whole, start: (part + held * start) / (whole + held)
            right = {
                v: (mean(row[f"{v}_yp"], row[f"{v}_yp"] + row[f"{v}_np"], yes), mean(row[f"{v}_no"], row[f"{v}_yo"] + row[f"{v}_no"], no))
                for v, (yes, no) in STARTS.items()
            }
            rates[row["kind"]] = (mean(row["personal"], row["all"], SHARES[row["kind"]]), right)
    return rates


def posterior(rates: Rates) -> Column:
    """Probability that a candidate of this kind with these votes is personal data."""
    odds = F.lit(0.0)
    for kind, (share, right) in rates.items():
        own = F.lit(math.log(share / (1 - share)))
        for v, (yes, no) in right.items():
            own = own + F.when(F.col(v) == 1, math.log(yes / (1 - no))).when(F.col(v) == -1, math.log((1 - yes) / no)).otherwise(0.0)
        odds = F.when(F.col("kind") == kind, own).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def _decoys(spark: SparkSession) -> DataFrame:
    """Every pattern of kind, votes and form, with weights that add up to ``DECOYS`` for each kind."""
    rows = spark.range(1).select(F.lit(DECOYS / 3 ** len(LABELERS) / 2 ** len(FORMS)).alias("n"), F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    for name, values in [*((v, (-1, 0, 1)) for v in LABELERS), *((f, (0, 1)) for f in FORMS)]:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return rows.select("kind", *LABELERS, *FORMS, "n")


def span_classifier(patterns: DataFrame, rates: Rates) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of the logistic regression on the soft labels of (kind, votes, form, n), at most 3 ** 5 * 4
    rows a kind. The patterns of each kind weigh 1 in all, its decoys ``DECOYS``."""
    whole = patterns.groupBy("kind").agg(F.sum("n").alias("all"))
    shares = patterns.join(whole, "kind").select("kind", *LABELERS, *FORMS, (F.col("n") / F.col("all")).alias("n"))
    rows = shares.union(_decoys(patterns.sparkSession)).withColumn("p", posterior(rates))
    label = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight"))))
    rows = rows.select(*[c.alias(name) for name, c in _features(F.col).items()], label.alias("l")).select(*FEATURES, "l.*")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label", "weight").coalesce(1)
    fitted = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(vectors)
    return float(fitted.intercept), dict(zip(FEATURES, map(float, fitted.coefficients)))


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) of every row, by start and kind; code points, end exclusive.

    Null and empty texts have no spans; repeated rows give repeated results; very long texts are searched whole, in one task;
    other columns are not read. A span of a further kind without signs for or against it follows its kind's share.
    Without any candidate nothing is fitted and all results are empty.
    """
    found = written(candidates(df, key, text), "candidates")
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts = written(each.groupBy("kind", *LABELERS, *FORMS).agg(F.count("*").cast("double").alias("n")), "patterns").coalesce(1)
    accept = lambda s: s["kind"].isin(*BASE)
    if not counts.isEmpty():
        rates = reliabilities(counts.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")))
        intercept, weights = span_classifier(counts, rates)
        bound = math.log(threshold / (1 - threshold))
        accept = lambda s: s["kind"].isin(*BASE) | (sum((c * weights[f] for f, c in _features(s.getField).items()), F.lit(intercept)) >= bound)
    return found.select(F.col(f"`{key}`"), F.transform(F.filter("found", accept), lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans of each row of :func:`detect`."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return detected.select(key, *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
