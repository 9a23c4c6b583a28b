"""Personal data in whole texts by weak supervision (operator 9).

Base findings are mail and internet addresses, card numbers and telephone numbers, each kind matched leftmost and without
overlap; matches that fail their test (parts, digits, Luhn sum) are dropped and not tried again.

Weaker candidates (names after a title, identity and bank numbers, dates, telephone numbers without a plus)
are judged by labelers that vote for, against or not at all: regular expressions on the shape, a gazetteer of names, the
words before the candidate, and base findings beside it. The gazetteer holds the given names of a list (a parameter) and
the words that most often make up mail addresses of the corpus, GAZETTEER at most, counted over all of them. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability and each pattern's probability. These soft labels train the span classifier, a naive
Bayes model over the features of spans, which decides what is added. Base findings vote too, and stay whatever it says.

The query searches the texts once, by column expressions where the rows are read: positions are sums of the lengths of the pieces
between matches. What is found is written to the shared folder, and the rest works on that. Only words of addresses and counts of
patterns are shuffled, combined before; the number of patterns is bounded by the product of the numbers of
votes and features, whatever the table's size, and the arithmetic on that list is plain.

Nulls and empty texts have no spans. Repeated rows give repeated rows; other columns are not read (``masked``
carries them). Positions are code points, ends exclusive. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.llm.common import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("name", "id_number", "date", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

# The patterns of the base findings. A run is entered only where it begins, or where the match before it has ended:
# elsewhere the same run would fail in the same way. Possessive repeats keep long texts off the stack.
MAIL_CHARS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{MAIL_CHARS})|\G){MAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)++|(?<![0-9])[0-9]{2,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried on it.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

# Patterns of the added kinds.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame"
CAPITALISED = r"\p{Lu}[\p{L}'-]{1,30}+"
PATTERNS |= {
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.?\x20{CAPITALISED}(?:\x20{CAPITALISED})?",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
ANY_TITLE = rf"(?:{TITLES})\.?\x20\p{{Lu}}"

# What the labelers look for.
GIVEN_NAMES = tuple("james mary john anna peter paul maria thomas hans petra jean marie pierre josé carmen juan michael sarah david laura".split())
#: Words of mail addresses in the gazetteer at most, and the letters and addresses such a word has at least.
GAZETTEER, NAME_LETTERS, NAME_ADDRESSES = 5_000, 3, 3
SHAPES = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}|^\([0-9]{3}\)"
ODD = r"^[^0-9]*([0-9])(?:[^0-9]*\1)*[^0-9]*$"
CUES = (
    r"(?:phone|call|mobile|tel|fax|telefon|teléfono|téléphone|ssn|social security|passport|iban|account|konto|born|birth|geboren|né|"
    r"nacid[oa]|name|signed|dear|contact|patient)[^\n]{0,20}$"
)
NO_CUES = r"(?:version|order|invoice|page|isbn|ticket|build|section|published|edition|revision|price|item)[^\n]{0,20}$"
BEFORE, NEAR = 40, 200

LABELERS = ("shape", "odd", "gazetteer", "cue", "near")
FEATURES = ("kind", "odd", "gazetteer", "cue", "near", "long")
#: Probability from which the classifier adds a span.
ADD_FROM = 0.6

SPAN = "struct<kind:int,start:int,end:int,text:string>"


def located(text: Column, kind: str) -> Column:
    """All matches of the kind's pattern as spans; a text that cannot match is not searched."""
    pattern = F.lit(PATTERNS[kind])
    number = KINDS.index(kind)

    def step(at: Column, x: Column) -> Column:
        begin = at["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(number).alias("kind"), begin.alias("start"), end.alias("end"), x["match"].alias("text"))
        found = F.when(x["match"].isNull(), at["found"]).otherwise(F.array_append(at["found"], span))
        return F.struct(end.alias("at"), found.alias("found"))

    nothing = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    gaps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")),
    )
    if kind == "name":
        tried = F.regexp_like(text, F.lit(ANY_TITLE))
    else:
        tried = F.regexp_like(text, F.lit("[0-9]")) if kind != "email" else F.lit(True)
        if NEEDS.get(kind):
            tried = F.contains(text, F.lit(NEEDS[kind])) & tried
    return F.when(tried, F.aggregate(gaps, start, step, lambda at: at["found"])).otherwise(nothing)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ten divides."""

    def part(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        return F.when(place % 2 == 0, value).otherwise(2 * value - F.when(value > 4, 9).otherwise(0))

    parts = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), part)
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x) % 10 == 0


def is_sound(kind: str, found: Column) -> Column:
    """The test of a base kind's match."""
    n = F.length(digits(found))
    if kind == "ip":
        small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3
        return F.forall(F.split(found, r"\."), lambda p: small(p) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), passes_luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def sound(text: Column, kind: str) -> Column:
    """The matches of a base kind that pass its test."""
    return F.filter(located(text, kind), lambda span: is_sound(kind, span["text"]))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` and ``_candidates``, the base findings by kind and start, and the weak candidates beside none of them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*(sound(whole, kind) for kind in BASE_KINDS))
    weak = F.concat(*(located(whole, k) for k in ADDED_KINDS))
    found = docs.withColumn("_base", base).withColumn("_weak", F.when(F.regexp_like(whole, F.lit(rf"[0-9]|{ANY_TITLE}")), weak).otherwise(F.array().cast(f"array<{SPAN}>")))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda c: ~F.exists("_base", lambda b: meets(b, c))
    return found.withColumn("_candidates", F.filter("_weak", free)).drop("_weak")


def name_words(span: Column) -> Column:
    """The words, in small letters, of a mail address before its sign or of a name after its title; none of other kinds."""
    named = F.when(span["kind"] == KINDS.index("email"), F.substring_index(span["text"], "@", 1)).when(
        span["kind"] == KINDS.index("name"), F.regexp_replace(span["text"], rf"^(?:{TITLES})\.?\x20", "")
    )
    words = F.filter(F.split(F.lower(named), r"[^\p{L}]+"), lambda w: F.length(w) >= NAME_LETTERS)
    return F.coalesce(words, F.array().cast("array<string>"))


def voted(spans: Column, base: Column, text: Column) -> Column:
    """The spans with their words for the gazetteer, each other labeler's vote (1, 0 or -1) and the features of the classifier."""

    def votes(span: Column) -> Column:
        start, found = span["start"], span["text"]
        before = F.lower(F.substr(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE))))
        near = F.exists(
            base,
            lambda b: (b["start"] < span["end"] + NEAR) & (start < b["end"] + NEAR) & ((b["start"] != start) | (b["kind"] != span["kind"])),
        )
        cue = F.regexp_like(before, F.lit(CUES)).cast("int") - F.regexp_like(before, F.lit(NO_CUES)).cast("int")
        return F.struct(
            span["kind"].alias("kind"),
            start.alias("start"),
            span["end"].alias("end"),
            name_words(span).alias("words"),
            F.regexp_like(found, F.lit(SHAPES)).cast("int").alias("shape"),
            (-F.regexp_like(found, F.lit(ODD)).cast("int")).alias("odd"),
            cue.alias("cue"),
            near.cast("int").alias("near"),
            F.least(F.floor(F.length(found) / 8), F.lit(3)).cast("int").alias("long"),
        )

    return F.transform(spans, votes)


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``_voted``: base findings by kind and start, then the weak candidates, with votes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = with_spans(docs, text)
    any_ = (F.size("_base") > 0) | (F.size("_candidates") > 0)
    votes = voted(F.concat("_base", "_candidates"), F.col("_base"), whole)
    nothing = F.filter(votes, lambda x: F.lit(False))
    return found.withColumn("_voted", F.when(any_, votes).otherwise(nothing)).drop("_base", "_candidates")


def gazetteer(found: DataFrame) -> list[str]:
    """The words that occur in the most mail addresses of the corpus, at least NAME_ADDRESSES; GAZETTEER of them at most."""
    mails = F.filter("_voted", lambda s: s["kind"] == KINDS.index("email"))
    words = found.where(F.size(mails) > 0).select(F.explode(F.flatten(F.transform(mails, lambda s: F.array_distinct(s["words"])))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= NAME_ADDRESSES)
    return [row.word for row in counted.orderBy(F.desc("n"), "word").limit(GAZETTEER).collect()]


def with_gazetteer(found: DataFrame, names: list[str]) -> DataFrame:
    """``_voted`` with the vote of the gazetteer on names; a mail address does not vouch for itself."""

    def vote(span: Column) -> Column:
        known = F.exists(span["words"], lambda w: w.isin(names)) if names else F.lit(False)
        return span.withField("gazetteer", ((span["kind"] == KINDS.index("name")) & known).cast("int"))

    return found.withColumn("_voted", F.transform("_voted", vote))


@dataclass(frozen=True)
class Classifier:
    """Log odds of a span before its features are seen, and what each value of each feature adds."""

    prior: float
    weights: dict[str, dict[int, float]]

    def accepts(self, span: Column) -> Column:
        odds = F.lit(self.prior)
        for name, values in self.weights.items():
            pairs = [F.lit(x) for pair in values.items() for x in pair]
            odds = odds + F.coalesce(F.element_at(F.create_map(*pairs), span[name]), F.lit(0.0))
        return odds >= math.log(ADD_FROM / (1 - ADD_FROM))


def estimated(patterns: list[tuple[dict[str, int], int]], rounds: int = 25) -> list[float]:
    """Expectation-maximisation: the probability that a span of each pattern of votes is personal data."""
    totals = [sum(votes[name] for name in LABELERS) for votes, _ in patterns]
    belief = [0.9 if total > 0 else 0.1 if total < 0 else 0.4 for total in totals]
    for _ in range(rounds):
        yes = sum(n * b for (_, n), b in zip(patterns, belief)) + 1
        no = sum(n * (1 - b) for (_, n), b in zip(patterns, belief)) + 1
        odds = [math.log(yes / no)] * len(patterns)
        for name in LABELERS:
            for vote in (-1, 0, 1):
                held = [i for i, (votes, _) in enumerate(patterns) if votes[name] == vote]
                # A labeler is taken to be right rather than wrong before its votes are counted.
                right = sum(patterns[i][1] * belief[i] for i in held) + (2 if vote > 0 else 1)
                wrong = sum(patterns[i][1] * (1 - belief[i]) for i in held) + (2 if vote < 0 else 1)
                for i in held:
                    odds[i] += math.log(right / (yes + 3)) - math.log(wrong / (no + 3))
        belief = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return belief


def trained(rows: list) -> Classifier | None:
    """The span classifier from counts of votes and features."""
    if not rows:
        return None
    counts: dict[tuple, int] = {}
    for row in rows:
        key = tuple(row[name] for name in LABELERS)
        counts[key] = counts.get(key, 0) + row["n"]
    keys = list(counts)
    belief = dict(zip(keys, estimated([(dict(zip(LABELERS, k)), counts[k]) for k in keys])))
    soft = [(row, row["n"] * belief[tuple(row[name] for name in LABELERS)]) for row in rows]
    yes, no = sum(b for _, b in soft) + 1, sum(row["n"] - b for row, b in soft) + 1
    weights: dict[str, dict[int, float]] = {}
    for name in FEATURES:
        values = sorted({row[name] for row in rows})
        weights[name] = {
            v: math.log((sum(b for row, b in soft if row[name] == v) + 1) / (yes + len(values)))
            - math.log((sum(row["n"] - b for row, b in soft if row[name] == v) + 1) / (no + len(values)))
            for v in values
        }
    return Classifier(math.log(yes / no), weights)


def learned(found: DataFrame) -> Classifier | None:
    """The classifier that the spans of all texts give; None if there is no span."""
    spans = found.select(F.explode("_voted").alias("span")).select("span.*")
    kept = list(dict.fromkeys(LABELERS + FEATURES))
    return trained(spans.groupBy(*kept).agg(F.count("*").alias("n")).collect())


@dataclass(frozen=True)
class Judge:
    """What decides on weak candidates: the gazetteer's names and the classifier (None if nothing was found)."""

    names: list[str]
    model: Classifier | None

    @classmethod
    def of(cls, found: DataFrame, names: tuple[str, ...] = GIVEN_NAMES) -> Judge:
        """Made from all that was found; ``names`` is the list of given names the gazetteer begins with."""
        known = list(dict.fromkeys([*names, *gazetteer(found)]))
        return cls(known, learned(with_gazetteer(found, known)))

    def findings(self, found: DataFrame, carried: tuple[str, ...]) -> DataFrame:
        """The carried columns with ``_base`` and ``_spans``: the base findings, and these with the added ones, by kind and start."""
        as_span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        is_base = lambda s: s["kind"] < len(BASE_KINDS)
        is_kept = is_base if self.model is None else lambda s: is_base(s) | self.model.accepts(s)
        return with_gazetteer(found, self.names).select(
            *carried,
            F.transform(F.filter("_voted", is_base), as_span).alias("_base"),
            F.transform(F.filter("_voted", is_kept), as_span).alias("_spans"),
        )


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: how many base findings of each kind, the digest of their places, and the places of all findings."""
    searches = written(searched(docs.select(key, text), text).select(key, "_voted"), "spans")
    found = Judge.of(searches).findings(searches, (key,))
    kinds = F.transform("_base", lambda span: span["kind"])
    counts = [
        (F.size("_base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)
    ]
    return found.select(key, *counts, F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every finding in the text replaced by its kind in angle brackets; findings that meet become one.

    The texts are searched twice: a table of all of them between the passes would take as much disk as they do.
    """
    whole = searched(docs.select(F.struct("*").alias("_row"), text), text)
    # Rows without findings are kept, too: a test on what is found would be pushed into the search and repeat it.
    judge = Judge.of(written(searched(docs.select(text), text).select("_voted"), "spans"))
    found = judge.findings(whole, ("_row", text))
    names = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))
    by_start = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )

    def step(at: Column, span: Column) -> Column:
        fresh = F.concat(at["out"], F.substr(F.col(text), at["at"] + 1, span["start"] - at["at"]), F.get(names, span["kind"]))
        return F.struct(
            F.greatest(at["at"], span["end"]).alias("at"),
            F.when(span["start"] >= at["at"], fresh).otherwise(at["out"]).alias("out"),
        )

    rest = lambda at: F.concat(at["out"], F.substr(F.col(text), at["at"] + 1, F.length(text)))
    rewritten = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    masked_text = F.when(F.size("_spans") > 0, rewritten).otherwise(F.col(text)).alias(text)
    return found.select(*(masked_text if name == text else F.col("_row")[name].alias(name) for name in docs.columns))
