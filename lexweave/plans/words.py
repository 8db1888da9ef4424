"""Queries over all words of the documents: transcriptions and sound laws, each with its SQL where it has one."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonology as ph
from ..functions import text as tx
from ..operators import laws
from ..operators.align import segments_of
from ..operators.forms import process_form
from ..sources.tables import SETS_SQL, WORDS_SQL, cognate_sets, last_forms, word_lexicon

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _words(sql: str) -> str:
    return WORDS_SQL + f"SELECT lang, form, {sql} AS made FROM words"


def _applied(spark, sf_dir: str, f) -> DataFrame:
    return word_lexicon(spark, sf_dir).withColumn("made", f(F.col("form")))


#: Letters with tone marks and what is left of them: made from the rule, for SQL without decomposition.
TONED = {c: s for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and len(s := tx.strip_tones(c)) == 1 and s != c}
TONES_SQL = f"translate({{}}, '{''.join(TONED)}', '{''.join(TONED.values())}')"
VOWEL_PAIRS = [v for v in tx.VOWELS if v.islower()]


def _nested(expression: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        expression = f"replace({expression}, '{a}', '{b}')"
    return expression


LONG_SQL = lambda x: _nested(x, [(v + v, v + tx.LONG) for v in VOWEL_PAIRS])
TIED_SQL = lambda x: f"CASE WHEN contains({x}, '{tx.TIE}') THEN {x} ELSE {_nested(x, [(a, a[0] + tx.TIE + a[1]) for a in tx.AFFRICATES])} END"
ASPIRATED_SQL = lambda x: f"regexp_replace(regexp_replace({x}, '([{tx.ASPIRABLE}])h', '\\1{tx.ASPIRATED}', 'g'), '({tx.TIE}[{tx.AFFRICATE_ENDS}])h', '\\1{tx.ASPIRATED}', 'g')"
_CONS = lambda c: f"coalesce(regexp_matches({c}, '^\\p{{L}}$') AND NOT regexp_matches({c}, '^[{tx.VOWELS}]$'), false)"
Y_SQL = lambda x: f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN substr({x}, i, 1) <> 'y' OR (i = 1 AND i = length({x})) OR {_CONS(f'nullif(substr({x}, i + 1, 1), %s)' % repr(''))} OR (i = length({x}) AND {_CONS(f'nullif(substr({x}, i - 1, 1), %s)' % repr(''))}) THEN substr({x}, i, 1) ELSE 'j' END), '')"


@query(_words("translate(form || '³¹', '⁰¹²³⁴⁵⁶⁷⁸⁹', '')"))
def strip_superscripts(spark, sf_dir):
    return _applied(spark, sf_dir, lambda c: tx.without_digits(F.concat(c, F.lit("³¹"))))


@query(_words(TONES_SQL.format("form")))
def tone_strip(spark, sf_dir):
    return _applied(spark, sf_dir, tx.tones_stripped)


@query(_words(LONG_SQL("form")))
def double_vowels(spark, sf_dir):
    return _applied(spark, sf_dir, tx.long_vowels)


@query(_words("replace(" + TIED_SQL("replace(replace(form, 'ñ', 'ɲ'), 'ng', 'ŋ')") + ", 'g', 'ɡ')"))
def digraphs_affricates(spark, sf_dir):
    return _applied(spark, sf_dir, lambda c: tx.single_g(tx.tied(tx.digraphs(tx.letters_mapped(c)))))


@query(_words(ASPIRATED_SQL("form")))
def aspiration(spark, sf_dir):
    return _applied(spark, sf_dir, tx.aspirated)


@query(_words(Y_SQL("form")))
def y_to_j(spark, sf_dir):
    return _applied(spark, sf_dir, tx.y_to_j)


@query(WORDS_SQL + f""", a AS (SELECT lang, form, {TONES_SQL.format('form')} AS x FROM words),
b AS (SELECT lang, form, replace(replace({LONG_SQL('x')}, 'ñ', 'ɲ'), 'ng', 'ŋ') AS x FROM a),
c AS (SELECT lang, form, {TIED_SQL('x')} AS x FROM b), d AS (SELECT lang, form, {ASPIRATED_SQL('x')} AS x FROM c)
SELECT lang, form, replace({Y_SQL('x')}, 'g', 'ɡ') AS made FROM d""")
def normalize_full(spark, sf_dir):
    return _applied(spark, sf_dir, tx.normalized)


TWO = "replace(form, 'e', '- ')"


@query(_words(f"coalesce(list_filter(regexp_split_to_array({TWO}, '[-\\s]+'), lambda x: x <> '')[2], {TWO})"))
def morpheme_extract(spark, sf_dir):
    return _applied(spark, sf_dir, lambda c: tx.morpheme(F.replace(c, F.lit("e"), F.lit("- ")), F.lit(1)))


@query(_words(f"array_to_string(regexp_split_to_array({TWO}, ' |-'), '/')"))
def morph_split_raw(spark, sf_dir):
    return _applied(spark, sf_dir, lambda c: F.array_join(tx.raw_morphs(F.replace(c, F.lit("e"), F.lit("- "))), "/"))


#: The letters of the inventory as a table, and the letters of a form one by one: words of texts have no other marks than those of their letters.
INVENTORY_SQL = "inventory AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in ph.inventory()) + ") t(letter))"


@query(WORDS_SQL.rstrip() + f", {INVENTORY_SQL}, letters AS (SELECT lang, form, i, substr(form, i, 1) AS letter FROM words, range(1, 400) r(i) WHERE i <= length(form)) SELECT lang, form, CAST(row_number() OVER (PARTITION BY lang, form ORDER BY i) - 1 AS INTEGER) AS place, letter AS seg FROM letters SEMI JOIN inventory USING (letter)")
def segments_exploded(spark, sf_dir):
    return word_lexicon(spark, sf_dir).select("lang", "form", F.posexplode(tx.segments(F.col("form"))).alias("place", "seg"))


@query(WORDS_SQL + "SELECT form, count(*) AS langs, min(lang) AS first_lang, max(lang) AS last_lang FROM words GROUP BY form HAVING count(*) > 1")
def shared_words(spark, sf_dir):
    return word_lexicon(spark, sf_dir).groupBy("form").agg(F.count("*").alias("langs"), F.min("lang").alias("first_lang"), F.max("lang").alias("last_lang")).where("langs > 1")


@query(WORDS_SQL + r""", s AS (SELECT lang, form, unnest(regexp_extract_all(form, '\p{L}')) AS seg FROM words)
SELECT lang, seg, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def phoneme_counts(spark, sf_dir):
    segs = word_lexicon(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all("form", F.lit(r"\p{L}"), F.lit(0))).alias("seg"))
    return segs.groupBy("lang", "seg").agg(F.count("*").alias("n")).where("n >= 2")


def _syllables(form: str) -> str:
    return "-".join(ph.syllables(segments_of(form)))


@query()
def syllabify(spark, sf_dir):
    return _applied(spark, sf_dir, lambda c: tx.each(_syllables)(tx.normalized(c)))


@query()
def processed_forms(spark, sf_dir):
    return word_lexicon(spark, sf_dir).select("lang", "form", process_form(F.col("form"))["processed"].alias("processed"))


@query()
def syllable_inventory(spark, sf_dir):
    """Distinct syllables of each language."""
    made = syllabify(spark, sf_dir)
    return made.select("lang", F.explode(F.split("made", "-")).alias("syllable")).where("syllable <> ''").distinct()


#: A system of laws made up for these words.
SYSTEM = r"""
name: sample
laws:
  shortening: ["ee", "e", "", ""]
  th-to-t: ["th", "t", "", ""]
  final-loss: ["e", "", "", "\\Z"]
  o-raising: ["o", "u", "", "[nm]"]
  voicing: ["t", "d", "[aeiou]", "[aeiou]"]
  a-to-e-final: ["a", "e", "", "\\Z"]
  s-to-h: {source: "s", target: "h", left: "", right: "[aeiou]"}
  nasal-drop: ["n", "", "[aeiou]", "[td]"]
tree:
  ROOT:
    - child: west
      laws: [shortening, th-to-t]
    - child: en
      laws: [final-loss, not-defined]
  west:
    - child: de
      laws: [voicing, o-raising]
    - child: south
      laws: [final-loss]
  south:
    - child: fr
      laws: [nasal-drop, s-to-h]
    - child: es
      laws: [a-to-e-final]
"""


def laws_sql(system: laws.System) -> dict[str, str]:
    """What the column form becomes at each leaf, in SQL."""
    out = {}
    for leaf, path in system.leaves().items():
        x = "form"
        for name in path:
            if law := system.laws.get(name):
                x = f"regexp_replace({x}, '({law.left})({law.source})({law.right.replace(chr(92) + 'Z', chr(92) + 'z')})', '\\1{law.target}\\3', 'g')"
        out[leaf] = x
    return out


_LEAVES = laws_sql(laws.System.loads(SYSTEM))
_APPLIED = " UNION ALL ".join(f"SELECT skey, form, '{leaf}' AS leaf, {x} AS hypothesis FROM protos" for leaf, x in _LEAVES.items())
_DETAIL = SETS_SQL + f", made AS ({_APPLIED}), detail AS (SELECT m.skey, m.leaf, m.form AS proto, m.hypothesis, d.form, m.hypothesis = d.form AS correct FROM made m JOIN lasts d ON m.skey = d.skey AND m.leaf = d.lang) "


@query(WORDS_SQL + " UNION ALL ".join(f"SELECT lang, form, '{leaf}' AS leaf, {x} AS hypothesis FROM words" for leaf, x in _LEAVES.items()))
def law_apply_leaves(spark, sf_dir):
    return laws.apply_laws(word_lexicon(spark, sf_dir), laws.System.loads(SYSTEM))


def _detail(spark, sf_dir):
    sets = last_forms(cognate_sets(spark, sf_dir))
    return laws.evaluate(sets.where("lang = 'proto'").select("skey", "form"), sets.where("lang <> 'proto'"), laws.System.loads(SYSTEM))


@query(_DETAIL + "SELECT * FROM detail")
def law_eval_detail(spark, sf_dir):
    return _detail(spark, sf_dir)


@query(_DETAIL + f"SELECT count(DISTINCT skey) AS n_sets, count(*) AS n_comparisons, count(CASE WHEN NOT correct THEN 1 END) AS n_errors, 1 - count(CASE WHEN NOT correct THEN 1 END) / count(*) AS accuracy, CAST({laws.System.loads(SYSTEM).penalty()} AS DOUBLE) AS penalty, count(CASE WHEN NOT correct THEN 1 END) + CAST({laws.System.loads(SYSTEM).penalty()} AS DOUBLE) AS score FROM detail")
def law_eval_metrics(spark, sf_dir):
    return laws.metrics(_detail(spark, sf_dir), laws.System.loads(SYSTEM))


