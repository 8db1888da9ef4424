"""The comparative method once more, in plain Python and all at once: what the queries are held against."""

import functools
import itertools
import unicodedata
from collections import Counter, defaultdict

import regex

from lexweave.functions import phonology as ph

TIE = "͡"
TONES = set("̀́̂̌̄̋̏᷄᷅᷈")
VOWEL_BASES = set("aeiouyɨʉɯɪʏʊøɘɵɤəɛœɜɞʌɔæɐɶɑɒ")


def known(letter):
    """A letter of the inventory, or the capital of one: in the table by itself or by what it is built on."""
    return known_small(letter) or any(known_small(c) and c.upper() == letter for c in (letter.lower(), *{"ʔ"}) if len(c) == 1)


def known_small(letter):
    return letter in ph.BASE or letter in "gß" or (letter.islower() and regex.match(r"\p{Ll}", letter) is not None and (0xC0 <= ord(letter) < 0x250 or 0x1E00 <= ord(letter) < 0x1F00) and unicodedata.normalize("NFD", letter)[0] in {*ph.BASE, "g"})


def segments(form):
    out, k = [], 0
    letters = list(form or "")
    while k < len(letters):
        if not known(letters[k]):
            k += 1
            continue
        cluster = letters[k]
        k += 1
        if k + 1 < len(letters) and letters[k] == TIE and known(letters[k + 1]):
            cluster += letters[k] + letters[k + 1]
            k += 2
        while k < len(letters) and (letters[k] in "ʰː" or regex.match(r"\p{M}", letters[k])):
            cluster += letters[k]
            k += 1
        out.append(cluster)
    return out


def pair(a, b, gap=3.0):
    """The pairs of the cheapest alignment, by recursion from the end."""

    @functools.cache
    def best(i, j):
        if i == 0 or j == 0:
            return gap * (i + j)
        return min(best(i - 1, j - 1) + ph.distance(a[i - 1], b[j - 1]), best(i - 1, j) + gap, best(i, j - 1) + gap)

    i, j, out = len(a), len(b), []
    while (i, j) != (0, 0):
        here = best(i, j)
        if i > 0 and j > 0 and here == best(i - 1, j - 1) + ph.distance(a[i - 1], b[j - 1]):
            out.insert(0, (a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i > 0 and here == best(i - 1, j) + gap:
            out.insert(0, (a[i - 1], ""))
            i -= 1
        else:
            out.insert(0, ("", b[j - 1]))
            j -= 1
    return out


def star(proto, members):
    """{(col, lang): seg} of a set with an ancestor: the slots of a column are (segment of the ancestor, place in the gap before it)."""
    middle = segments(proto)
    cells = {}
    for lang, form in [("proto", proto), *members]:
        own, before, place = {}, 0, 0
        pairs = [(s, s) for s in middle] if lang == "proto" else pair(middle, segments(form))
        for x, y in pairs:
            if x:
                own[before, "at"] = y
                before, place = before + 1, 0
            else:
                own[before, place] = y
                place += 1
        cells[lang, form] = own
    slots = {s for own in cells.values() for s in own} | {(k, "at") for k in range(len(middle))}
    order = sorted(slots, key=lambda s: (s[0], s[1] == "at", 0 if s[1] == "at" else s[1]))
    out = {}
    for (lang, _), own in cells.items():
        for c, s in enumerate(order):
            out[c, lang] = own.get(s, "")  # the last form of a language stays
    return out


def merge(columns, languages):
    """Correspondence sets of columns [((skey, col), {lang: seg})], in order: [(pattern, [column, ...])], all ancestor sounds at once."""
    groups = {}
    for at, held in columns:
        groups.setdefault(tuple(held.get(x) for x in languages), []).append(at)
    patterns, members = [list(p) for p in groups], [list(m) for m in groups.values()]
    n = len(patterns)
    if n <= 1:
        return [(tuple(p), m) for p, m in zip(patterns, members, strict=True)]
    blank = lambda k: sum(1 for x in patterns[k] if x is None or x == "")
    agree = lambda a, b: not any(x is not None and y is not None and x != y for x, y in zip(patterns[a], patterns[b], strict=True))
    better = lambda j, i: blank(j) < blank(i) or (blank(j) == blank(i) and len(members[j]) > len(members[i]))
    by_sound = defaultdict(list)
    for k in range(n):
        by_sound[patterns[k][0]].append(k)
    turns = sorted((-blank(i), blank(j), -len(members[j]), i, j) for own in by_sound.values() for i in own for j in own if i != j and better(j, i) and agree(i, j))
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for *_, i, j in turns:
        a, b = find(i), find(j)
        if a != b and agree(a, b) and better(b, a):
            members[b] = members[b] + members[a]
            patterns[b] = [x if x is not None else y for x, y in zip(patterns[b], patterns[a], strict=True)]
            root[a] = b
    return [(tuple(patterns[k]), members[k]) for k in range(n) if root[k] == k and sum(1 for x in patterns[k] if x) >= 2]


def minimal(positive, negative):
    """Search through all choices of one, two and all shared features."""
    if None in positive and None not in negative:
        return {"#": 1}
    wanted = [dict(ph.features(s)) for s in positive if s is not None and ph.features(s)]
    others = [dict(ph.features(s)) for s in negative if s is not None and ph.features(s)]
    if not wanted:
        return None
    shared = [(f, wanted[0][f]) for f in ph.FEATURES if wanted[0][f] != 0 and len({x[f] for x in wanted}) == 1]
    choices = [[x] for x in shared] + [list(x) for x in itertools.combinations(shared, 2)] + ([shared] if shared else [])
    for choice in choices:
        if not any(all(o.get(f, 0) == v for f, v in choice) for o in others):
            return dict(choice)
    return None


def words(left, right):
    def one(spec, edge, place):
        return edge if spec == {"#": 1} else f"{place} [" + ", ".join(("+" if spec[f] > 0 else "-") + f for f in sorted(spec)) + "]"

    out = [one(left, "word-initially", "after")] if left else []
    out += [one(right, "word-finally", "before")] if right else []
    return " and ".join(out) if out else "no distinguishing context"


def syllabify(parts, conflated=True):
    grid = [ph.sonority(p) for p in parts]
    if conflated:
        grid = [9 if g >= 8 else g if g >= 5 else 4 for g in grid]
    starts = [True] * len(parts)
    peaks = [k for k, g in enumerate(grid) if g >= 8]
    if peaks:
        for i in range(1, len(parts)):
            last = i == len(parts) - 1
            if i < peaks[0] or i > peaks[-1]:
                starts[i] = False
            if grid[i - 1] < grid[i]:
                starts[i] = False
            if grid[i - 1] > grid[i] and (last or grid[i] >= grid[i + 1]):
                starts[i] = False
            if grid[i - 1] == grid[i] == grid[i - 2]:
                starts[i] = False
    out = []
    for p, s in zip(parts, starts, strict=True):
        if s:
            out.append("")
        out[-1] += p
    return out


def normalized(form):
    """The ten steps of normal form, one character at a time."""
    if not form:
        return form
    nfd, nfc = lambda x: unicodedata.normalize("NFD", x), lambda x: unicodedata.normalize("NFC", x)
    out = ""
    for c in nfd(form):
        if c == "̣" and out and out[-1] in "tdsznl":
            out = out[:-1] + dict(zip("tdsznl", "ʈɖʂʐɳɭ", strict=True))[out[-1]]
        else:
            out += c
    x = nfc("".join(c for c in nfd(nfc(out)) if c not in TONES))
    x = "".join(c for c in x if c not in "⁰¹²³⁴⁵⁶⁷⁸⁹")
    vowel = lambda c: c.islower() and nfd(c)[0] in VOWEL_BASES
    out, k = "", 0
    while k < len(x):
        if k + 1 < len(x) and x[k] == x[k + 1] and vowel(x[k]):
            out, k = out + x[k] + "ː", k + 2
        else:
            out, k = out + x[k], k + 1
    x = out.replace("ñ", "ɲ").replace("ñ", "ɲ").replace("ng", "ŋ")
    if TIE not in x:
        for a in ["ts", "dz", "tʃ", "dʒ", "tɕ", "dʑ", "tθ", "dð", "pf", "bv", "kx", "ɡɣ", "tɬ", "dɮ"]:
            x = x.replace(a, a[0] + TIE + a[1])
    y = ""
    for k, c in enumerate(x):
        after = k > 0 and (x[k - 1] in "pbtdkgɡcɟqɢʔʈɖ" or (k > 1 and x[k - 1] in "szʃʒɕʑθðfvxɣɬɮ" and x[k - 2] == TIE))
        y += "ʰ" if c == "h" and after else c
    x, y = y, ""
    consonant = lambda c: c is not None and unicodedata.category(c).startswith("L") and not vowel(c)
    for k, c in enumerate(x):
        before, after = x[k - 1] if k else None, x[k + 1] if k + 1 < len(x) else None
        first, last = before in (None, " ", "-"), after in (None, " ", "-")
        stays = (first and last) or consonant(after) or (last and consonant(before))
        y += "j" if c == "y" and not stays else c
    return y.replace("g", "ɡ")


def processed(form):
    x = normalized(form.strip()).replace("-", "")
    return " ".join("-".join(syllabify(segments(w))) or w for w in x.split(" ") if w) if form.strip() else ""


def tfidf(texts, grams, features):
    """{id: {gram: weight}}."""
    held = {i: Counter(grams(t)) for i, t in texts.items()}
    total, df = Counter(), Counter()
    for c in held.values():
        total.update(c)
        df.update(c.keys())
    chosen = sorted(total, key=lambda g: (-total[g], g))[:features]
    import math

    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in chosen}
    out = {}
    for i, c in held.items():
        w = {g: c[g] * idf[g] for g in c if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {g: x / norm for g, x in w.items()}
    return out
