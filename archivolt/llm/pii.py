"""Personal data: base patterns, and a span classifier trained by weak supervision. DataFrame functions only."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import table

# A match starts at the start of a run of its first class or right where the last match ended: any later start in the
# run would have been found from there. Together with possessive loops this keeps every pattern linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{16,}+"
NUMBER = r"(?<![0-9+.])[0-9][0-9() .-]{7,}[0-9]"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")
LABELERS = ("regex", "gazetteer", "context")
FEATURES = (*LABELERS, "kind", "size", "after_sign")

#: Gazetteers, lower case.
ASKED = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "phone", "tel", "call", "fax", "mobile",
         "card", "account", "iban", "ssn", "social", "passport", "mail", "contact", "ip", "host", "id", "telefon",
         "konto", "tarjeta", "carte", "cuenta")
OTHER = ("version", "page", "chapter", "vol", "fig", "figure", "isbn", "issn", "doi", "year", "date", "rfc", "section")
SECRET_STARTS = ("akia", "asia", "ghp_", "gho_", "sk-", "sk_", "xox", "ya29", "eyj")
RESERVED = ("10.", "127.", "192.168.", "0.", "169.254.", "255.")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")

_BLOCK = 256


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once: Spark evaluates a shared sub-expression anew at each use inside lambdas
    and conditions, but a lambda's variable only once."""
    return F.transform(F.array(value), then)[0]


def _offsets(lengths: Column) -> Column:
    """Sums before each element. Blocks keep the copying of growing arrays at n * _BLOCK instead of n * n."""

    def scan(values: Column, start: Column) -> Column:
        seed = F.array(start.cast("long"))
        return F.aggregate(values, seed, lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def join(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
        inner = lambda x, start: F.slice(scan(x, start), 1, F.size(x))
        return F.flatten(F.zip_with(blocks, F.slice(scan(sums, F.lit(0)), 1, F.size(blocks)), inner))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    return _let(blocks, join)


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """Array of {start, end, match, before}: leftmost non-overlapping matches, in code points. The gaps that split()
    leaves between the matches give their places and their left context (up to 24 code points, back to the last match)."""
    def places(pairs: Column) -> Column:
        size = lambda p: (F.char_length(p["m"]) + F.char_length(p["g"])).cast("long")
        return F.zip_with(
            pairs,
            _let(F.transform(pairs, size), _offsets),
            lambda p, at: F.struct(
                (at + F.char_length(p["g"])).alias("start"),
                (at + F.char_length(p["g"]) + F.char_length(p["m"])).alias("end"),
                p["m"].alias("match"),
                F.lower(F.right(p["g"], F.lit(24))).alias("before"),
            ),
        )

    def paired(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return _let(F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), places)

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string>>")
    return F.when(gate & text.rlike(pattern), spans).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum over the digits, given last first, of which every second counts double (less 9 where that is over 9)."""

    def weigh(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i + 1, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def _valid_card(match: Column) -> Column:
    checked = lambda d: F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False)
    return _let(F.reverse(_digits(match)), checked)


def _valid_ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.char_length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), small)


def _starts(value: Column, words: tuple) -> Column:
    return reduce(Column.__or__, (value.startswith(w) for w in words))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    """A candidate with the labelers' votes (1, -1, 0 for none) and the classifier's other features."""
    match, low, before = s["match"], F.lower(s["match"]), s["before"]
    never = F.lit(False)
    if kind in BASE:
        shape = F.lit(1)
    elif kind == "secret":
        shape = _vote(match.rlike("^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$"), match.rlike("^[0-9_-]+$"))
    else:
        shape = _vote(
            match.rlike(r"^(?:[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"),
            match.rlike(r"^(?:[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}.*)$"),
        )
    known = {
        "email": _vote(low.rlike(r"\.(?:com|net|org|edu|gov|info|io|de|fr|es|uk)$"), never),
        "ip": _vote(never, _starts(match, RESERVED)),
        "card": _vote(_starts(match, ISSUERS), never),
        "phone": _vote(_starts(match, ("+1", "+33", "+34", "+44", "+49")), never),
        "secret": _vote(_starts(low, SECRET_STARTS), never),
        "number": _vote(never, _starts(match, ("19", "20", "0."))),
    }[kind]
    words = lambda w: before.rlike(r"(?:^|[^a-z])(?:" + "|".join(w) + r")[^a-z]*$")
    context = _vote(words(ASKED), words(OTHER))
    size = F.least(F.floor(F.char_length(match) / 8), F.lit(5)).cast("int")
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        F.lit(KINDS.index(kind)).alias("rank"), shape.alias("regex"), known.alias("gazetteer"),
        context.alias("context"), size.alias("size"), before.rlike("[=:][^a-z0-9]*$").alias("after_sign"),
    )


def candidates(text: Column) -> tuple[Column, Column]:
    """(base spans, further candidates) of a text, as arrays of voted spans. Candidates never overlap base spans."""
    digit = text.rlike("[0-9]")
    found = {
        "email": _found(text, EMAIL, text.contains("@")),
        "ip": F.filter(_found(text, IP, digit), lambda s: _valid_ip(s["match"])),
        "card": F.filter(_found(text, CARD, digit), lambda s: _valid_card(s["match"])),
        "phone": F.filter(
            _found(text, PHONE, digit & text.contains("+")), lambda s: F.char_length(_digits(s["match"])).between(10, 15)
        ),
    }
    more = {
        "secret": _found(text, SECRET, digit),
        "number": F.filter(_found(text, NUMBER, digit), lambda s: F.char_length(_digits(s["match"])) >= 9),
    }
    voted = lambda spans: F.concat(*(F.transform(v, partial(_votes, k)) for k, v in spans.items()))
    return voted(found), voted(more)


def with_candidates(docs: DataFrame) -> DataFrame:
    """`docs` with __base and __more (arrays of voted spans); a null text has none."""
    base, more = candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))
    clear = F.filter(
        "__more",
        lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return docs.withColumns({"__base": base, "__more": more}).withColumn("__more", clear)


def estimate(patterns: list[tuple[dict, int]], rounds: int = 40) -> tuple[float, dict, list[float]]:
    """Expectation-maximisation of a two-class model in which each labeler votes by a distribution of its own.

    patterns: (votes, number of spans). Returns the prior, {labeler: {vote: [P if not personal, P if personal]}} and
    each pattern's posterior. The start is the mean vote, which fixes which class is which.
    """
    post = [min(max(0.5 + sum(p[lab] for lab in LABELERS) / 4, 0.05), 0.95) for p, _ in patterns]
    prior, reliability = 0.5, {}
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(q * n for q, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        for lab in LABELERS:
            counts = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for q, (p, n) in zip(post, patterns):
                counts[p[lab]][0] += (1 - q) * n
                counts[p[lab]][1] += q * n
            sums = [sum(c[k] for c in counts.values()) for k in (0, 1)]
            reliability[lab] = {v: [c[k] / sums[k] for k in (0, 1)] for v, c in counts.items()}
        odds = [
            math.log(prior / (1 - prior)) + sum(math.log(reliability[lab][p[lab]][1] / reliability[lab][p[lab]][0]) for lab in LABELERS)
            for p, _ in patterns
        ]
        post = [1 / (1 + math.exp(-max(-50, min(50, o)))) for o in odds]
    return prior, reliability, post


def train(docs: DataFrame) -> dict:
    """The span classifier: {"bias": log odds, feature: {value: log odds}}.

    Spans of the whole table are counted by their feature values; these counts alone reach the driver (at most
    6 kinds x 27 votes x 6 sizes x 2). EM on the votes gives each pattern a probability, and those probabilities train
    a naive Bayes classifier over votes, kind, size and the sign before the span.
    """
    spans = with_candidates(docs.select("text")).select(F.explode(F.concat("__base", "__more")).alias("s")).select("s.*")
    rows = spans.groupBy(*FEATURES).count().orderBy(*FEATURES).collect()
    patterns = [(r.asDict(), r["count"]) for r in rows]
    if not patterns:
        return {"bias": 0.0}
    _, _, post = estimate(patterns)
    sums = [1 + sum((1 - q) * n for q, (_, n) in zip(post, patterns)), 1 + sum(q * n for q, (_, n) in zip(post, patterns))]
    model: dict = {"bias": math.log(sums[1] / sums[0])}
    for f in FEATURES:
        counts: dict = defaultdict(lambda: [1.0, 1.0])
        for q, (p, n) in zip(post, patterns):
            counts[p[f]][0] += (1 - q) * n
            counts[p[f]][1] += q * n
        model[f] = {v: math.log(c[1] / (sums[1] + len(counts)) / (c[0] / (sums[0] + len(counts)))) for v, c in counts.items()}
    return model


def _score(model: dict, span: Column) -> Column:
    total = F.lit(model["bias"])
    for f in FEATURES:
        part = F.lit(0.0)
        for value, odds in model.get(f, {}).items():
            part = F.when(span[f] == F.lit(value), odds).otherwise(part)
        total = total + part
    return total


def _detected(docs: DataFrame) -> DataFrame:
    model = train(docs)
    bare = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    more = F.filter("__more", lambda s: _score(model, s) > 0)
    spans = F.sort_array(F.concat(F.transform("__base", bare), F.transform(more, bare)))
    base = F.sort_array(F.transform("__base", bare))
    return with_candidates(docs).withColumns({"__spans": spans, "__base": base}).drop("__more")


def detect(docs: DataFrame) -> DataFrame:
    """`docs` with `base` and `spans`: arrays of {start, rank, kind, end} in code points, by start and then kind.

    base holds the valid matches of the four base patterns; spans has these and the candidates (secrets, bare numbers)
    that the classifier gives more than even odds. Two scans and one exchange of pattern counts; documents never move.
    A null or empty text has no spans. Rows are independent, so null or repeated ids don't matter. Columns named base
    and spans are replaced. An empty table gives an empty one. A long text is searched whole: every pattern takes time in
    proportion to it, and sums over its matches are made in blocks.
    """
    return _detected(docs.drop("base", "spans")).withColumnsRenamed({"__base": "base", "__spans": "spans"})


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets; of overlapping spans the first one is named
    and all are covered. A null text stays null."""
    found = _detected(docs.withColumn("__text", F.col("text").cast("string")))
    text = F.col("__text")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        new = F.concat(a["done"], gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        inside = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["done"]).otherwise(new).alias("done")
        )

    tail = lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    new = F.when(F.size("__spans") > 0, F.aggregate("__spans", state, step, tail)).otherwise(text)
    return found.withColumn("text", new).drop("__text", "__base", "__spans")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_spans: all spans, with those that the classifier adds (secrets and bare numbers)."""
    found = detect(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
