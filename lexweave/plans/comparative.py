"""Queries of the comparative method, each with its SQL where it has one."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonology as ph
from ..operators import align, correspond, generalize
from ..sources.kept import kept
from ..sources.tables import SETS_SQL, cognate_sets, last_forms, lexicon_sets, star_lexicon

QUERIES, ORACLES = {}, {}
LANGUAGES = ["proto", "de", "en", "es", "fr"]
SEGMENTS = sorted(ph.BASE)
FEATURE_ROWS = [(s, f, v) for s in SEGMENTS for f, v in ph.features(s)]
FEATURES_SQL = "features AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', {v})" for s, f, v in FEATURE_ROWS) + ") t(seg, feat, val)), weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {w})" for f, w in ph.WEIGHTS.items()) + ") t(feat, weight))"


#: SQL's edit distance counts bytes: letters beyond ASCII are first put as capitals, which no form has.
BEYOND = "éèêëàâäáçñíìîïóòôöúùûüßœæ"


def ascii_sql(x: str) -> str:
    return f"translate({x}, '{BEYOND}', '{''.join(chr(65 + k) for k in range(len(BEYOND)))}')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def feature_table(spark) -> DataFrame:
    return spark.createDataFrame(FEATURE_ROWS, "seg string, feat string, val int")


def aligned(spark, sf_dir) -> DataFrame:
    """All alignment columns, made once."""
    return kept(align.align_sets(cognate_sets(spark, sf_dir)))


#: The k-th letters of the last forms of a set as a column: an alignment without gaps inside, which SQL can make.
POSITIONAL = SETS_SQL + """, cells AS (SELECT skey, lang, CAST(k - 1 AS INTEGER) AS col, substr(form, k, 1) AS seg FROM (SELECT skey, 'proto' AS lang, form FROM protos UNION ALL SELECT * FROM lasts) l, range(1, 400) r(k) WHERE k <= length(form)),
pat AS (SELECT skey, col, max(CASE WHEN lang = 'proto' THEN seg END) AS p0, max(CASE WHEN lang = 'de' THEN seg END) AS p1, max(CASE WHEN lang = 'en' THEN seg END) AS p2, max(CASE WHEN lang = 'es' THEN seg END) AS p3, max(CASE WHEN lang = 'fr' THEN seg END) AS p4 FROM cells GROUP BY 1, 2)
"""


def positional(spark, sf_dir) -> DataFrame:
    letters = F.filter(F.split("form", ""), lambda x: x != "")
    return last_forms(cognate_sets(spark, sf_dir)).select("skey", "lang", F.posexplode(letters).alias("col", "seg"))


CANONICAL = "CASE seg WHEN 'v' THEN 'w' WHEN 'ɹ' THEN 'r' ELSE seg END"
#: The letter whose features a segment has: without its marks, of which none here changes them.
LETTER = f"CASE strip_accents({CANONICAL}) WHEN 'g' THEN 'ɡ' WHEN 'ß' THEN 's' ELSE strip_accents({CANONICAL}) END"


@query(POSITIONAL + ", " + FEATURES_SQL + f""", named AS (SELECT *, {CANONICAL} AS c, {LETTER} AS letter FROM cells),
d AS (SELECT a.seg AS a, b.seg AS b, sum(weight * abs(a.val - b.val)) / 2 AS cost FROM features a JOIN features b USING (feat) JOIN weights USING (feat) GROUP BY 1, 2)
SELECT x.seg AS a, y.seg AS b, count(*) AS n, CAST(CASE WHEN x.c = y.c THEN 0 ELSE coalesce(any_value(d.cost), 100) END AS DOUBLE) AS cost FROM named x JOIN named y ON x.skey = y.skey AND x.col = y.col AND x.lang = 'proto' AND y.lang <> 'proto' LEFT JOIN d ON d.a = x.letter AND d.b = y.letter GROUP BY x.seg, y.seg, x.c, y.c""")
def phoneme_distance_matrix(spark, sf_dir):
    """Distances of all letters that stand for one another: each of an ancestor form, and what a daughter has in its place; how often."""
    cells = kept(positional(spark, sf_dir))
    here = cells.where("lang = 'proto'").select("skey", "col", F.col("seg").alias("a"))
    pairs = cells.where("lang <> 'proto'").select("skey", "col", F.col("seg").alias("b")).join(here, ["skey", "col"])
    return ph.with_distance(kept(pairs.groupBy("a", "b").agg(F.count("*").alias("n"))))


def shown(pattern):
    return F.array_join(F.transform(pattern, lambda x: F.coalesce(x, F.lit("?"))), "")


SHOWN = "coalesce(p0, '?') || coalesce(p1, '?') || coalesce(p2, '?') || coalesce(p3, '?') || coalesce(p4, '?')"


@query(SETS_SQL + "SELECT * FROM sets")
def cognate_set_members(spark, sf_dir):
    return cognate_sets(spark, sf_dir)


CANONICAL = "CASE seg WHEN 'v' THEN 'w' WHEN 'ɹ' THEN 'r' ELSE seg END"


def _pairs(spark, sf_dir) -> DataFrame:
    sets = cognate_sets(spark, sf_dir)
    protos = sets.where("lang = 'proto'").select("skey", F.col("form").alias("proto"))
    return sets.where("lang <> 'proto'").join(protos, "skey").select("skey", "lang", "proto", "form")


@query(SETS_SQL + "SELECT d.skey, d.lang, d.form, CAST(levenshtein(" + ascii_sql("p.form") + ", " + ascii_sql("d.form") + ") AS DOUBLE) AS cost FROM daughters d JOIN protos p USING (skey)")
def nw_unit_cost(spark, sf_dir):
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = _pairs(spark, sf_dir).select("skey", "lang", "form", letters(F.col("proto")).alias("a"), letters(F.col("form")).alias("b"))
    return align.pair_costs(rows, align.unit_cost, 1.0).select("skey", "lang", "form", "cost")


@query()
def align_pair(spark, sf_dir):
    """Each form beside its ancestor, gaps as dashes."""

    @F.pandas_udf("string")
    def made(a, b):
        rows = (align.align_pair(align.segments_of(x), align.segments_of(y)) for x, y in zip(a, b, strict=True))
        return a.__class__([" ".join(f"{x or '-'}:{y or '-'}" for x, y in r) for r in rows])

    return _pairs(spark, sf_dir).select("skey", "lang", "form", made("proto", "form").alias("aligned"))


@query(SETS_SQL + """, cells AS (SELECT skey, lang, form, k, substr(form, k, 1) AS seg FROM daughters, range(1, 400) r(k) WHERE k <= length(form)),
often AS (SELECT skey, k, seg, count(*) AS n, sum(count(*)) OVER (PARTITION BY skey, k) AS total FROM cells GROUP BY 1, 2, 3),
t AS (SELECT skey, lang, form, sum(total - n) AS total FROM cells JOIN often USING (skey, k, seg) GROUP BY 1, 2, 3)
SELECT skey, lang, form FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY total, lang, form) AS k FROM t) WHERE k = 1""")
def center_sequence(spark, sf_dir):
    """The most central form of each set, letters differing by one; forms of a set have one length."""
    return align.centers(cognate_sets(spark, sf_dir).where("lang <> 'proto'"), align.unit_cost)


@query()
def star_alignment(spark, sf_dir):
    return aligned(spark, sf_dir)


@query(POSITIONAL + f"SELECT {SHOWN} AS pattern, count(*) AS n, min(skey) AS first_skey FROM pat GROUP BY 1")
def patterns_exact(spark, sf_dir):
    rows = correspond.exact_groups(correspond.patterns(positional(spark, sf_dir), LANGUAGES))
    return rows.select(shown(F.col("pattern")).alias("pattern"), "n", F.col("first.skey").alias("first_skey"))


@query(POSITIONAL + """, g AS (SELECT p0, p1, p2, p3, p4, count(*) AS n FROM pat GROUP BY ALL),
named AS (SELECT *, concat_ws('', coalesce(p1, '?'), coalesce(p2, '?'), coalesce(p3, '?'), coalesce(p4, '?')) AS name FROM g WHERE p0 IS NOT NULL)
SELECT a.p0 AS proto_seg, a.name AS a, count(*) AS n, min(b.name) AS first_b, max(b.name) AS last_b FROM named a JOIN named b ON a.p0 = b.p0 WHERE a.name <> b.name
AND NOT coalesce(a.p1 <> b.p1, false) AND NOT coalesce(a.p2 <> b.p2, false) AND NOT coalesce(a.p3 <> b.p3, false) AND NOT coalesce(a.p4 <> b.p4, false) GROUP BY 1, 2""")
def pattern_compat_pairs(spark, sf_dir):
    """Of every distinct pattern the compatible ones of its ancestor sound: how many, the first and the last."""
    groups = correspond.exact_groups(correspond.patterns(positional(spark, sf_dir), LANGUAGES)).withColumn("proto_seg", F.get("pattern", F.lit(0))).where("proto_seg is not null")
    tail = F.slice(F.transform("pattern", lambda x: F.coalesce(x, F.lit("?"))), 2, 4)
    groups = kept(groups.select("proto_seg", F.array_join(tail, "").alias("name"), "pattern"))
    return correspond.compatible_counts(groups, "name").select("proto_seg", F.col("name").alias("a"), "n", F.col("first").alias("first_b"), F.col("last").alias("last_b"))


def sets_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Alignment columns and correspondence sets, each made once."""
    columns = aligned(spark, sf_dir)
    return columns, kept(correspond.correspondence_sets(kept(correspond.patterns(columns, LANGUAGES))))


@query()
def correspondence_sets(spark, sf_dir):
    _, sets = sets_of(spark, sf_dir)
    return correspond.ordered(sets).select("set_id", "proto_seg", shown(F.col("pattern")).alias("pattern"), "n", "n_filled")


@query()
def lexicon_correspondences(spark, sf_dir):
    """Correspondence sets of one ancestor language of the lexicon, with the glosses they begin and end with."""
    lexicon = star_lexicon(spark, sf_dir)
    names = lexicon.languages.join(lexicon.ancestry.where("plangid = 1001"), "langid", "left_semi").orderBy("name").select("name").collect()  # the ancestor's daughters
    languages = ["proto", *[r["name"] for r in names]]
    sets = kept(lexicon_sets(lexicon, 1001, languages[1:]))
    rows = correspond.patterns(align.align_sets(sets.select("skey", "lang", "form")), languages).join(sets.where("lang = 'proto'").select("skey", "gloss"), "skey")
    found = correspond.ordered(correspond.correspondence_sets(kept(rows)))
    segs = correspond.by_language(F.col("pattern"), languages)
    return found.select("set_id", "proto_seg", "n", F.map_keys(segs).alias("languages"), F.map_values(segs).alias("segments"), F.get("columns", F.lit(0))["gloss"].alias("first_gloss"), F.get("columns", F.size("columns") - 1)["gloss"].alias("last_gloss"))


@query()
def phonemes_to_analyse(spark, sf_dir):
    return correspond.phonemes_worth_analysing(sets_of(spark, sf_dir)[1])


@query()
def set_languages(spark, sf_dir):
    _, sets = sets_of(spark, sf_dir)
    return correspond.languages_with_data(sets, cognate_sets(spark, sf_dir)).select("set_id", F.array_join("languages", ",").alias("languages"))


@query(POSITIONAL + "SELECT skey, min(col) AS col FROM cells WHERE lang = 'fr' AND seg = 'e' GROUP BY skey")
def cognates_by_phoneme(spark, sf_dir):
    return correspond.cognates_by_segment(positional(spark, sf_dir), "fr", "e")


@query(POSITIONAL + f"SELECT skey, col, {SHOWN} AS pattern FROM pat WHERE regexp_matches(coalesce(p4, '-'), '^[aeé]') AND regexp_matches(coalesce(p1, '-'), '-|e')")
def client_pattern_filter_sort(spark, sf_dir):
    rows = correspond.pattern_view(correspond.patterns(positional(spark, sf_dir), LANGUAGES), LANGUAGES, {"fr": "^[aeé]", "de": "-|e", "en": "(["}, "es", True)
    return rows.select("skey", "col", shown(F.col("pattern")).alias("pattern"))


CONTEXTS = POSITIONAL + ", ctx AS (SELECT skey, col, seg, lag(seg) OVER (PARTITION BY skey ORDER BY col) AS \"left\", lead(seg) OVER (PARTITION BY skey ORDER BY col) AS \"right\" FROM cells WHERE lang = 'proto') "


@query(CONTEXTS + "SELECT * FROM ctx")
def contexts_lag_lead(spark, sf_dir):
    return generalize.contexts(positional(spark, sf_dir).where("lang = 'proto'"))


@query(CONTEXTS + "SELECT seg, count(DISTINCT coalesce(\"left\", '#') || '/' || coalesce(\"right\", '#')) AS diversity FROM ctx GROUP BY seg")
def context_diversity(spark, sf_dir):
    return generalize.diversity(contexts_lag_lead(spark, sf_dir), "seg")


NEXT = CONTEXTS.rstrip() + ", " + FEATURES_SQL + """, nxt AS (SELECT DISTINCT seg, CASE "right" WHEN 'g' THEN 'ɡ' ELSE "right" END AS r FROM ctx WHERE "right" IS NOT NULL),
known AS (SELECT n.seg, n.r, f.feat, f.val FROM nxt n JOIN features f ON n.r = f.seg),
consistent AS (SELECT seg, feat, min(val) AS val FROM known GROUP BY 1, 2 HAVING min(val) = max(val) AND min(val) <> 0) """


def _next_features(spark, sf_dir) -> DataFrame:
    right = F.when(F.col("right") == "g", "ɡ").otherwise(F.col("right"))
    following = contexts_lag_lead(spark, sf_dir).where("right is not null").select(F.col("seg").alias("of"), right.alias("seg")).distinct()
    return following.join(F.broadcast(feature_table(spark)), "seg").select(F.col("of"), "seg", "feat", "val")


def _consistent(known: DataFrame) -> DataFrame:
    return known.groupBy(F.col("of").alias("seg"), "feat").agg(F.min("val").alias("val"), F.max("val").alias("most")).where("val = most and val <> 0").drop("most")


@query(NEXT + "SELECT seg, feat, val FROM consistent")
def consistent_features(spark, sf_dir):
    """Features that all known segments share which follow a sound."""
    return _consistent(_next_features(spark, sf_dir))


@query(NEXT + "SELECT c.seg, o.seg AS other, min(c.feat) AS feat FROM consistent c JOIN (SELECT DISTINCT seg FROM known) o ON c.seg <> o.seg WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.seg = o.seg AND k.feat = c.feat AND k.val = c.val) GROUP BY 1, 2")
def minimal_single_feature(spark, sf_dir):
    """The first feature of what follows one sound that nothing following another has."""
    known = _next_features(spark, sf_dir)
    others = known.select(F.col("of").alias("other")).distinct()
    has = known.select(F.col("of").alias("other"), "feat", "val").distinct()
    pairs = _consistent(known).join(F.broadcast(others), F.col("seg") != F.col("other"))
    return pairs.join(has, ["other", "feat", "val"], "left_anti").groupBy("seg", "other").agg(F.min("feat").alias("feat"))


def _set_contexts(spark, sf_dir) -> DataFrame:
    columns, sets = sets_of(spark, sf_dir)
    places = sets.select("set_id", "proto_seg", F.explode("columns").alias("c")).select("set_id", "proto_seg", "c.skey", "c.col")
    around = generalize.contexts(columns.where("lang = 'proto'"))
    return places.join(around, ["skey", "col"]).select("set_id", "proto_seg", "left", "right")


@query()
def pairwise_generalization(spark, sf_dir):
    return generalize.pairwise(_set_contexts(spark, sf_dir)).orderBy("proto_seg", "a", "b")


@query()
def default_and_conditioned(spark, sf_dir):
    return generalize.default_and_conditioned(_set_contexts(spark, sf_dir)).orderBy("proto_seg", "set_id")


TWO = "replace(d.form, 'e', '-')"


@query(SETS_SQL + f""", m AS (SELECT d.skey, d.lang, d.form, regexp_split_to_array({TWO}, ' |-') AS parts, p.form AS proto FROM daughters d JOIN protos p USING (skey)),
s AS (SELECT skey, lang, form, i - 1 AS i, levenshtein({ascii_sql('parts[i]')}, {ascii_sql('proto')}) / greatest(length(parts[i]), length(proto), 1) AS d FROM m, range(1, 400) r(i) WHERE i <= len(parts) AND len(parts) > 1 AND parts[i] <> '')
SELECT m.skey, m.lang, m.form, CAST(coalesce(x.i, 0) AS INTEGER) AS morph_index FROM m LEFT JOIN (SELECT skey, lang, form, arg_min(i, (d, i)) AS i FROM s GROUP BY 1, 2, 3) x USING (skey, lang, form)""")
def best_morph(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("skey", "lang", F.col("form").alias("whole"), F.replace("form", F.lit("e"), F.lit("-")).alias("form"), F.col("proto").alias("proto_form"))
    return align.best_morpheme(rows).select("skey", "lang", F.col("whole").alias("form"), F.col("morph_index").cast("int").alias("morph_index"))


@query()
def best_morph_by_features(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("skey", "lang", F.col("form").alias("whole"), F.replace("form", F.lit("e"), F.lit("-")).alias("form"), F.col("proto").alias("proto_form"))
    return align.best_morpheme_by_features(rows).select("skey", "lang", F.col("whole").alias("form"), "morph_index")
