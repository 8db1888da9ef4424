"""Secrets: fixed patterns, and tests of randomness on every long token.

A token's encoding is inferred from its characters. Its symbols are drawn at random if three tests
let that stand: a chi-squared test of their uniformity over the alphabet, a runs test of how often
the class of character changes, and a test of serial correlation. That alone would call every token
random that is too short to tell, so a token is a secret only if it is also shown not to be
ordinary. Ordinary tokens are made of words and numbers: their symbols repeat nearly as those of
all texts do, which are counted, and the class of character changes once in four characters or
less often (once in eight, if they have one case and no marks). The probability that an ordinary
token of its length repeats so few symbols and that of so many changes are combined by Fisher's
method. Among all tokens of like length the Benjamini-Hochberg procedure then decides which aren't
ordinary, so that of what is reported a bounded share is. All of it is made of built-in
expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import array_literal, let, words_column

#: The base patterns, and the length a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED, MIN_ACCESS = 8, 16
#: Tokens that are tested for randomness.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
DIGITS, LOWER, UPPER, MARKS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/-_="
VOWELS = "aeiouAEIOU"
#: (pattern of a whole token, its alphabet), the narrowest first; the last fits every token.
ENCODINGS = [
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z_-]+$", DIGITS + LOWER + "-_"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+=*$", UPPER + LOWER + DIGITS),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    (r"^", UPPER + LOWER + DIGITS + MARKS),
]
#: Share of ordinary tokens among those reported; p-values are rounded up to steps of a twentieth of a decade.
FALSE_DISCOVERY, STEPS, LAST_STEP, LENGTH_CLASSES = 0.05, 20, 400, 12
#: Share of random tokens that the battery may turn away; how often the class of character changes in an ordinary token, at most: of one case without marks, and others.
REJECTED, ORDINARY_CHANGES = 0.001, (0.125, 0.25)
#: Characters up to which the probability of so many changes is exact.
EXACT = 128
BLOCK = 256


def sums_before(lengths: Column) -> Column:
    """For each position of an int array the sum of those before it, by way of sums of blocks, so that long arrays stay cheap."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    n = F.size(lengths)

    def with_blocks(blocks: Column) -> Column:
        heads = F.transform(blocks, lambda _, k: add(F.slice(blocks, 1, k)))
        return let(heads, lambda p: F.transform(lengths, lambda _, i: F.get(p, F.floor(i / BLOCK).cast("int")) + add(F.slice(lengths, (i - i % BLOCK + 1).cast("int"), (i % BLOCK).cast("int")))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: add(F.slice(lengths, k * BLOCK + 1, BLOCK)))
    return F.when(n > 0, let(blocks, with_blocks)).otherwise(F.expr("cast(array() as array<int>)"))


def match_spans(text: Column, pattern: str, kind: int, accept) -> Column:
    """array<struct<start, kind, end, value>> of the accepted matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def locate(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            both = F.zip_with(gaps, matches, lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
            before = lambda p: F.transform(matches, lambda m, i: F.struct((F.get(p, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(kind).alias("kind"), (F.get(p, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"), m.alias("value")))
            return F.filter(let(sums_before(both), before), lambda s: accept(s["value"]))

        return let(F.split(text, pattern, -1), with_gaps)

    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    return let(found, lambda m: F.when(F.size(m) > 0, locate(m)).otherwise(none))


def accept_assign(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= MIN_ASSIGNED


def accept_access(value: Column) -> Column:
    return F.length(value) >= MIN_ACCESS


def accept_hex(value: Column) -> Column:
    return F.lit(True)


#: kind: (pattern, condition), in the order in which kinds are listed.
BASE = {"assign": (ASSIGN, accept_assign), "access": (ACCESS, accept_access), "hex": (HEX, accept_hex)}
KINDS = [*BASE, "random"]


def _upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a logistic approximation."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def changes_of(alphabet: str) -> tuple[str, str, float, float]:
    """Characters and their classes, as two texts for translate; the probability that two random neighbours differ in class, and that they and the next do both times, less its square. Letters of one case alone are vowels and others, else classes are cases, digits and marks."""
    one = len({c.isdigit() or c in MARKS for c in alphabet}) == 1 and len({c.isupper() for c in alphabet}) == 1
    kind = (lambda c: "v" if c in VOWELS else "c") if one else (lambda c: "d" if c.isdigit() else "m" if c in MARKS else "u" if c.isupper() else "l")
    classes = "".join(map(kind, alphabet))
    share = [classes.count(c) / len(classes) for c in sorted(set(classes))]
    change = 1 - sum(p * p for p in share)
    return alphabet, classes, change, sum(p * (1 - p) ** 2 for p in share) - change * change


def single_case(alphabet: str) -> bool:
    """Whether ordinary words in that alphabet say nothing by the changes of class: their vowels change more often than random ones."""
    return "v" in changes_of(alphabet)[1]


def ordinary_changes(alphabet: str) -> int:
    """Which of ORDINARY_CHANGES holds in that alphabet."""
    return int(any(c in MARKS for c in alphabet) or (any(c.isupper() for c in alphabet) and any(c.islower() for c in alphabet)))


def binomial_tails(p: float, most: int) -> list[int]:
    """For n and s up to most, at n * (most + 1) + s: thousandths of minus the natural logarithm of the probability that s or more of n come true."""
    out = []
    for n in range(most + 1):
        terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(n + 1)]
        tail, row = 0.0, []
        for t in reversed(terms):
            tail += math.exp(t)
            row.append(math.floor(max(0.0, -1000 * math.log(min(1.0, tail)))))
        out += row[::-1] + [row[0]] * (most - n)
    return out


def _battery(symbols: Column, k: Column, counted: Column, changes: Column, change: Column, twice: Column) -> Column:
    """The probability that random symbols, given as positions in an alphabet of k, look so little random; counted: how often each occurs, changes: of class."""
    n = F.size(symbols).cast("double")
    squares = F.aggregate(counted, F.lit(0.0), lambda a, c: a + c * c)
    df = k - 1
    chi = k / n * squares - n
    z1 = (F.pow(chi / df, F.lit(1.0 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    z2 = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * twice)
    later = F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(symbols, 1, F.greatest(F.size(symbols) - 1, F.lit(0))), later, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    middle = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + s) / n

    def order(m: Column) -> Column:
        power = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + F.pow(s - m, F.lit(2.0)))
        along = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - m) * (p["b"] - m))
        return F.when(power > 0, (n * along / power + 1) / F.sqrt(n)).otherwise(F.lit(12.0))

    return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z1), _two_sided(z2), _two_sided(let(middle, order))))


def _ordinary(n: Column, repeats: Column, changes: Column, same: Column, thrice: Column, rate: Column, by_class: Column) -> Column:
    """The probability that an ordinary token of n characters has so few pairs of equal symbols (repeats) and so many changes of class; same and thrice: that two and three of its symbols are equal; rate: which of ORDINARY_CHANGES holds."""
    pairs = n * (n - 1) / 2
    spread = F.sqrt(pairs * same * (1 - same) + n * (n - 1) * (n - 2) * F.greatest(thrice - same * same, F.lit(0.0)))
    few = _upper_tail((pairs * same - repeats - 0.5) / spread)
    tails = array_literal([x for p in ORDINARY_CHANGES for x in binomial_tails(p, EXACT)], "int")
    exact = F.exp(-F.get(tails, (rate * (EXACT + 1) ** 2 + (n - 1) * (EXACT + 1) + changes).cast("int")) / 1000.0)
    p = F.when(rate == 0, ORDINARY_CHANGES[0]).otherwise(ORDINARY_CHANGES[1])
    z = (changes - 0.5 - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p))
    many = F.when(n - 1 <= EXACT, exact).otherwise(_upper_tail(z))
    both = F.greatest(few * many, F.lit(1e-40))
    return F.when(by_class, both * (1 - F.log(both))).otherwise(few)


def encoding_of(token: Column) -> Column:
    """The number of the first encoding that fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for k in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[k][0]), F.lit(k)).otherwise(out)
    return out


@dataclass(frozen=True)
class Limits:
    """same, thrice: for each encoding the probability that two, and three, symbols of an ordinary token are equal; steps: for each class of length the step from which tokens aren't ordinary."""

    same: tuple[float, ...]
    thrice: tuple[float, ...]
    steps: tuple[int, ...] = (LAST_STEP + 1,) * LENGTH_CLASSES


def test_token(token: Column, limits: Limits) -> Column:
    """struct<step, length_class, random>: in steps how improbable the token is as an ordinary one (0: not at all), the class of its length, and whether the battery lets it pass as random."""
    body = F.rtrim(token, F.lit("="))
    parts = [changes_of(a) for _, a in ENCODINGS]
    pick = lambda values, e, kind: F.element_at(F.array(*[F.lit(v) for v in values]), e + 1).cast(kind)

    def measure(e: Column, body: Column) -> Column:
        alphabet = pick([a for a, *_ in parts], e, "string")
        n = F.length(body)
        count = lambda text, letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
        symbols = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("int") - 1)
        # translate for each encoding by itself, as it takes its tables only once
        classes = F.lit("")
        for k, (letters, kinds, _, _) in reversed(list(enumerate(parts))):
            classes = F.when(e == k, F.translate(body, letters, kinds)).otherwise(classes)
        changes = (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).cast("double")
        repeats = F.aggregate(count(F.lower(body), F.lit(LOWER + DIGITS + MARKS)), F.lit(0.0), lambda a, c: a + c * (c - 1) / 2)

        def judge(changes: Column) -> Column:
            battery = let(symbols, lambda s: let(count(body, alphabet), lambda o: _battery(s, F.length(alphabet).cast("double"), o, changes, pick([p[2] for p in parts], e, "double"), pick([p[3] for p in parts], e, "double"))))
            p = _ordinary(n.cast("double"), repeats, changes, pick(limits.same, e, "double"), pick(limits.thrice, e, "double"), pick([ordinary_changes(a) for _, a in ENCODINGS], e, "int"), pick([not single_case(a) for _, a in ENCODINGS], e, "boolean"))
            step = F.least(F.floor(-STEPS * F.log10(F.greatest(p, F.lit(1e-30)))).cast("int"), F.lit(LAST_STEP))
            length_class = F.least(F.floor(F.log2(n / 10.0)).cast("int"), F.lit(LENGTH_CLASSES - 1))
            return F.struct(F.greatest(step, F.lit(0)).alias("step"), F.greatest(length_class, F.lit(0)).alias("length_class"), (battery >= REJECTED).alias("random"))

        return let(changes, judge)

    # a token of marks alone has no symbols
    plain = F.struct(F.lit(0).alias("step"), F.lit(0).alias("length_class"), F.lit(False).alias("random"))
    return let(body, lambda b: F.when(F.length(b) > 1, let(encoding_of(token), lambda e: measure(e, b))).otherwise(plain))


def replaced(text: Column, pattern: str, accept, put) -> Column:
    """text with put(match) in the place of each accepted match; put together from what lies between the matches, in one pass."""

    def join(t: Column, matches: Column) -> Column:
        piece = lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).when(accept(m), put(m)).otherwise(m))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), matches, piece), "")

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, join(t, m)).otherwise(t)))


def blanked(text: Column) -> Column:
    """text with spaces in the place of base matches: what is left is searched for random tokens."""
    for pattern, accept in BASE.values():
        text = replaced(text, pattern, accept, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return text


def symbol_limits(docs: DataFrame, text_column: str = "text") -> Limits:
    """How often two and three symbols of an ordinary token are equal, by encoding: names and numbers repeat less than prose, so each is drawn from all symbols of all texts, as they are counted, or as often from the alphabet. Cases count as one, and each symbol once more than it occurs."""
    letters = LOWER + DIGITS + MARKS
    # words are counted first, so that the symbols of each are counted once
    words = docs.select(F.explode(words_column(F.lower(docs[text_column]))).alias("w")).groupBy("w").count()
    sums = words.agg(*[F.sum(F.col("count") * (F.octet_length("w") - F.octet_length(F.replace("w", F.lit(c), F.lit(""))))) for c in letters]).first()
    held = {c: 1 + (n or 0) for c, n in zip(letters, sums, strict=True)}
    same, thrice = [], []
    for _, alphabet in ENCODINGS:
        counts = [held[c] for c in sorted(set(alphabet.lower()))]
        share = [(c / sum(counts) + 1 / len(counts)) / 2 for c in counts]
        same.append(sum(p**2 for p in share))
        thrice.append(sum(p**3 for p in share))
    return Limits(tuple(same), tuple(thrice))


def discoveries(counts: dict[int, int], share: float = FALSE_DISCOVERY) -> int:
    """The step from which tokens are discoveries by Benjamini-Hochberg, given how many have each step; one more than the last if none is."""
    total, below, limit = sum(counts.values()), 0, LAST_STEP + 1
    for step in sorted(counts, reverse=True):
        below += counts[step]
        if 10 ** (-step / STEPS) <= share * below / total:
            limit = step
    return limit


def fit_limits(docs: DataFrame, text_column: str = "text", share: float = FALSE_DISCOVERY) -> Limits:
    """What is needed to judge tokens of docs: symbols are counted over all texts, and discoveries are decided over all tokens."""
    limits = symbol_limits(docs, text_column)
    tokens = docs.select(F.explode(F.regexp_extract_all(blanked(docs[text_column]), F.lit(TOKEN), F.lit(0))).alias("token"))
    counts = tokens.select(test_token(F.col("token"), limits).alias("t")).groupBy("t.length_class", "t.step").count()
    held: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # at most LENGTH_CLASSES * (LAST_STEP + 1) rows
        held.setdefault(r["length_class"], {})[r["step"]] = r["count"]
    return Limits(limits.same, limits.thrice, tuple(discoveries(held.get(c, {}), share) for c in range(LENGTH_CLASSES)))


def is_random(token: Column, limits: Limits) -> Column:
    found = lambda x: x["random"] & (x["step"] >= F.element_at(F.array(*map(F.lit, limits.steps)), x["length_class"] + 1))
    return let(test_token(token, limits), found)


def with_secrets(docs: DataFrame, limits: Limits, text_column: str = "text", into: str = "_secrets") -> DataFrame:
    """docs with one more column into: array<struct<start, kind, end, value>>, by start, then kind.

    Kinds are numbered as in KINDS. Base spans are those of the fixed patterns, of one kind never
    overlapping; spans of the kind random are looked for in what base spans leave and touch none
    of them. A null text counts as empty. Every row is judged by itself; repeated rows get equal
    results, and further columns pass through (one that is named into is an error: take a free
    name). A very long text is searched whole, in time that grows with its length. No rows give no
    rows.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {into} is taken")
    text = F.coalesce(docs[text_column], F.lit(""))
    base = F.array_sort(F.concat(*[match_spans(text, p, k, accept) for k, (p, accept) in enumerate(BASE.values())]))
    random = let(blanked(text), lambda t: match_spans(t, TOKEN, KINDS.index("random"), lambda v: is_random(v, limits)))
    apart = lambda b, r: F.filter(r, lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    both = lambda b, r: F.when(F.size(r) == 0, b).otherwise(F.array_sort(F.concat(b, apart(b, r))))
    return docs.withColumn(into, let(base, lambda b: let(random, lambda r: both(b, r))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, limits: Limits, mark: str = "[SECRET]") -> Column:
    """text with every base match, and then every random token that is left, replaced by mark."""
    for pattern, accept in [*BASE.values(), (TOKEN, lambda v: is_random(v, limits))]:
        text = replaced(text, pattern, accept, lambda m: F.lit(mark))
    return text
