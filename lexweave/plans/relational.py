"""Queries over the star-schema lexicon, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import edits, search
from ..operators.correspond import last_of_language
from ..operators.search import Search
from ..sources.files import delimiter_counts, first_lines
from ..sources.tables import STAR_SQL, read, star_lexicon

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL over the lexicon."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (STAR_SQL if "WITH" not in sql[:5] else "") + sql
        return f

    return add


PAGE = "SELECT r.refid, r.langid, l.name, r.ipaform, r.gloss, CAST(CASE WHEN r.refid IN (SELECT refid FROM edges) THEN 1 ELSE 0 END AS INTEGER) AS in_set FROM reflexes r JOIN languages l USING (langid)"


def _page(spark: SparkSession, sf_dir: str, **terms) -> DataFrame:
    return search.search_reflexes(star_lexicon(spark, sf_dir), Search(**terms)).select("refid", "langid", "name", "ipaform", "gloss", "in_set")


@query(PAGE + " WHERE translate(l.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a%' AND lower(r.ipaform) LIKE '%widget%' AND r.gloss IS NOT NULL ORDER BY r.ipaform DESC, r.refid LIMIT 50 OFFSET 10")
def search_like_page(spark, sf_dir):
    return _page(spark, sf_dir, language="A", form="Widget", order="ipaform", descending=True, start=10, length=50)


@query(PAGE + " WHERE l.name IS NOT NULL AND regexp_matches(r.ipaform, '^(red|cold)', 'i') AND r.gloss IS NOT NULL")
def search_regex_page(spark, sf_dir):
    return _page(spark, sf_dir, form="^(red|cold)", length=-1)


@query(PAGE + " WHERE l.name IS NOT NULL AND lower(r.ipaform) LIKE '%d%w_d%' AND r.gloss IS NOT NULL")
def search_wildcard_unescaped(spark, sf_dir):
    return _page(spark, sf_dir, form="d%w_d", length=-1)


@query(PAGE + " WHERE false")
def search_invalid_regex(spark, sf_dir):
    return _page(spark, sf_dir, form="^(red", length=-1)


@query("SELECT refid, gloss FROM (SELECT refid, nullif(gloss, 'PROMO') AS gloss FROM reflexes) WHERE gloss IS NOT NULL")
def search_null_excluded(spark, sf_dir):
    rows = star_lexicon(spark, sf_dir).reflexes.select("refid", F.nullif("gloss", F.lit("PROMO")).alias("gloss"))
    return rows.where(search.matches(F.col("gloss"), ""))


@query("SELECT refid, CAST(CASE WHEN refid IN (SELECT refid FROM edges) THEN 1 ELSE 0 END AS INTEGER) AS in_set FROM reflexes")
def in_set_flag(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return search.with_set_flag(lexicon.reflexes.select("refid"), lexicon)


@query("SELECT DISTINCT r.refid, r.langid, r.form FROM reflexes r JOIN ancestry a ON r.langid = a.plangid")
def protoform_semi(spark, sf_dir):
    return search.protoforms(star_lexicon(spark, sf_dir)).select("refid", "langid", "form")


@query("SELECT refid, form FROM reflexes WHERE langid IN (SELECT plangid FROM ancestry) AND refid IN (SELECT prefid FROM edges WHERE refid IN (1, 2, 3, 5, 8, 13))")
def protoforms_of_reflexes(spark, sf_dir):
    return search.protoforms_of(star_lexicon(spark, sf_dir), search.ids_of("1,2,x,3,-4,5,8,13")).select("refid", "form")


@query("SELECT refid, prefid FROM edges WHERE refid NOT IN (SELECT refid FROM reflexes WHERE langid < 20)")
def cleanup_not_in(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return edits.delete_not_in(lexicon.edges, "refid", lexicon.reflexes.where("langid < 20").select("refid"))[1].select("refid", "prefid")


@query("SELECT count(*) AS n FROM reflexes r WHERE EXISTS (SELECT 1 FROM ancestry a WHERE a.plangid = r.langid)")
def exists_count(spark, sf_dir):
    return search.protoforms(star_lexicon(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("SELECT e.prefid, e.refid, r.langid, l.name, r.form, e.morph_index FROM edges e JOIN reflexes r ON e.refid = r.refid JOIN languages l ON r.langid = l.langid")
def cognate_join(spark, sf_dir):
    return search.cognate_rows(star_lexicon(spark, sf_dir)).select("prefid", "refid", "langid", "name", "form", "morph_index")


@query("SELECT count(*) AS total, count(CASE WHEN lower(l.name) LIKE '%a%' AND lower(r.ipaform) LIKE '%e%' AND r.gloss IS NOT NULL THEN 1 END) AS filtered FROM reflexes r LEFT JOIN languages l USING (langid)")
def page_counts(spark, sf_dir):
    return search.counts(star_lexicon(spark, sf_dir), Search(language="a", form="e"))


@query("SELECT count(DISTINCT refid) AS n FROM edges e JOIN ancestry a ON e.plangid = a.plangid")
def distinct_count(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return lexicon.edges.join(lexicon.ancestry.select("plangid").distinct(), "plangid", "left_semi").agg(F.countDistinct("refid").alias("n"))


@query("SELECT DISTINCT l.name, l.langid FROM reflexes r JOIN languages l USING (langid)")
def language_list(spark, sf_dir):
    return search.named(star_lexicon(spark, sf_dir)).select("name", "langid").distinct()


@query("SELECT DISTINCT l.langid, l.name FROM languages l WHERE langid IN (SELECT plangid FROM ancestry)")
def proto_languages(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return lexicon.languages.join(lexicon.ancestry.select(F.col("plangid").alias("langid")), "langid", "left_semi").distinct()


@query("SELECT DISTINCT x.langid AS a, y.langid AS b FROM ancestry x JOIN ancestry y ON x.plangid = y.plangid AND x.langid <> y.langid")
def shared_ancestor(spark, sf_dir):
    return search.sharing_ancestor(star_lexicon(spark, sf_dir).ancestry)


@query("SELECT langid, coalesce(CASE WHEN langid % 3 = 0 THEN 'code' || langid ELSE NULL END, nullif(name, 'FRANCE'), 'lang_' || langid) AS identifier FROM languages")
def identifier_fallback(spark, sf_dir):
    code = F.expr("CASE WHEN langid % 3 = 0 THEN concat('code', langid) WHEN langid % 3 = 1 THEN 'unk' ELSE '' END")
    rows = star_lexicon(spark, sf_dir).languages.withColumn("glottocode", code).withColumn("name", F.nullif("name", F.lit("FRANCE")))
    return search.language_identifiers(rows).select("langid", "identifier")


@query("SELECT prefid, langid, max(refid) AS refid FROM edges JOIN reflexes USING (refid) GROUP BY 1, 2")
def latest_per_language(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return last_of_language(lexicon.edges.join(lexicon.reflexes.select("refid", "langid"), "refid"))


@query("SELECT prefid, min(refid) AS refid, count(*) AS members, list_aggregate(list_sort(list(refid)), 'string_agg', ',') AS ids FROM edges GROUP BY prefid")
def cognate_set_groups(spark, sf_dir):
    rows = star_lexicon(spark, sf_dir).edges.groupBy("prefid").agg(F.min("refid").alias("refid"), F.count("*").alias("members"), F.array_sort(F.collect_list("refid")).alias("x"))
    return rows.select("prefid", "refid", "members", F.array_join(F.col("x").cast("array<string>"), ",").alias("ids"))


@query("SELECT prefid, refid, rank FROM (SELECT prefid, refid, row_number() OVER (PARTITION BY prefid ORDER BY refid) AS rank FROM edges) WHERE rank <= 2")
def first_two_per_set(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("prefid").orderBy("refid"))
    return star_lexicon(spark, sf_dir).edges.select("prefid", "refid", rank.cast("long").alias("rank")).where("rank <= 2")


@query("SELECT r.refid, e.prefid, r.langid, l.name, r.gloss, e.morph_index, array_to_string(list_transform(range(1, len(string_split(r.ipaform, ' ')) + 1), lambda i: CASE WHEN i = e.morph_index + 1 THEN '<strong>' || string_split(r.ipaform, ' ')[i] || '</strong>' ELSE string_split(r.ipaform, ' ')[i] END), ' ') AS ipaform FROM edges e JOIN reflexes r ON e.refid = r.refid JOIN languages l ON r.langid = l.langid")
def supporting_forms(spark, sf_dir):
    return search.supporting(star_lexicon(spark, sf_dir))


@query("SELECT refid, prefid, plangid, morph_index FROM edges UNION ALL SELECT refid + 1, prefid, plangid, 7 FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.refid = e.refid + 1 AND x.prefid = e.prefid)")
def upsert_edges(spark, sf_dir):
    edges = star_lexicon(spark, sf_dir).edges
    return edits.add_edges(edges, edges.select((F.col("refid") + 1).alias("refid"), "prefid", "plangid", F.lit(7).alias("morph_index")))


@query("SELECT refid, CASE WHEN langid = 7 THEN upper(form) ELSE form END AS form, CASE WHEN langid = 7 THEN 'changed' ELSE gloss END AS gloss FROM reflexes")
def update_projection(spark, sf_dir):
    rows = edits.update_where(star_lexicon(spark, sf_dir).reflexes, F.col("langid") == 7, form=F.upper("form"), gloss=F.lit("changed"))
    return rows.select("refid", "form", "gloss")


@query("SELECT e.refid, e.prefid, r.langid, l.name, r.form, r.gloss FROM edges e JOIN reflexes r USING (refid) JOIN languages l USING (langid) WHERE e.plangid = 1001 AND r.langid NOT IN (SELECT langid FROM ancestry WHERE plangid = 1001)")
def cleanup_report(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return edits.foreign_edges(lexicon.reflexes, lexicon.languages, lexicon.ancestry, lexicon.edges, 1001).select("refid", "prefid", "langid", "name", "form", "gloss")


@query("SELECT refid, prefid, CAST(CASE WHEN refid = 7 AND prefid % 2 = 0 THEN 5 ELSE morph_index END AS INTEGER) AS morph_index FROM edges")
def update_edges(spark, sf_dir):
    rows = edits.update_where(star_lexicon(spark, sf_dir).edges, (F.col("refid") == 7) & (F.col("prefid") % 2 == 0), morph_index=F.lit(5))
    return rows.select("refid", "prefid", "morph_index")


@query("SELECT refid, prefid, plangid, morph_index FROM edges WHERE plangid <> 1001 OR refid IN (SELECT refid FROM reflexes WHERE langid IN (SELECT langid FROM ancestry WHERE plangid = 1001))")
def cleanup_edges(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return edits.clean_up(lexicon.reflexes, lexicon.languages, lexicon.ancestry, lexicon.edges, 1001, dry_run=False)[0].select("refid", "prefid", "plangid", "morph_index")


@query("""SELECT i AS place, w AS word, coalesce(nullif(g, ''), 'unknown') AS gloss, coalesce(nullif(x, ''), f) AS form, CASE WHEN coalesce(x, '') IN ('', '-') THEN CASE WHEN refid % 2 = 0 THEN '∅' ELSE '—' END ELSE x END AS shown, refid FROM (
SELECT refid, unnest(range(0, len(regexp_extract_all(gloss, '[A-Za-z]+')))) AS i, unnest(regexp_extract_all(gloss, '[A-Za-z]+')) AS w, CASE refid % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE gloss END AS g, CASE refid % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '-' ELSE ipaform END AS x, form AS f FROM reflexes)""")
def shown_words(spark, sf_dir):
    """The words of all glosses, and fallbacks for what is missing."""
    rows = star_lexicon(spark, sf_dir).reflexes
    g = F.expr("CASE refid % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE gloss END")
    x = F.expr("CASE refid % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '-' ELSE ipaform END")
    return rows.select("refid", F.posexplode(tx.gloss_words(F.col("gloss"))).alias("place", "word"), tx.gloss_or_unknown(g).alias("gloss"), tx.form_or_fallback(x, F.col("form")).alias("form"), tx.shown(x, F.col("refid") % 2 == 0).alias("shown"))


@query("SELECT refid, prefid FROM edges WHERE prefid NOT IN (SELECT refid FROM reflexes WHERE langid = 1001)")
def delete_cascade(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return edits.delete_reflexes(lexicon.reflexes, lexicon.edges, lexicon.reflexes.where("langid = 1001").select("refid"), "prefid")[1].select("refid", "prefid")


@query("SELECT refid, langid, form, gloss FROM reflexes WHERE langid <> 3 UNION ALL SELECT refid, langid, 'new ' || form, gloss FROM reflexes WHERE langid = 3")
def upsert_rows(spark, sf_dir):
    rows = star_lexicon(spark, sf_dir).reflexes.select("refid", "langid", "form", "gloss")
    return edits.upsert(rows, rows.where("langid = 3").withColumn("form", F.concat(F.lit("new "), "form")), "refid")


@query("SELECT 'intersect' AS op, langid FROM (SELECT langid FROM ancestry INTERSECT SELECT langid FROM reflexes) UNION ALL SELECT 'except', langid FROM (SELECT langid FROM reflexes EXCEPT SELECT langid FROM ancestry) UNION ALL SELECT 'union', langid FROM (SELECT langid FROM ancestry UNION SELECT langid FROM reflexes)")
def set_ops_languages(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    a, b = lexicon.ancestry.select("langid"), lexicon.reflexes.select("langid")
    parts = {"intersect": a.intersect(b), "except": b.subtract(a), "union": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("op"), "langid")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT langid, refid, form FROM reflexes r WHERE langid IN (SELECT langid FROM ancestry WHERE plangid = 1001)")
def selected_languages(spark, sf_dir):
    lexicon = star_lexicon(spark, sf_dir)
    return lexicon.reflexes.join(lexicon.ancestry.where("plangid = 1001"), "langid", "left_semi").select("langid", "refid", "form")


@query("""WITH x AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')[1:5], chr(10)) AS head FROM documents),
n AS (SELECT doc_id, length(head) - length(replace(head, chr(9), '')) AS tabs, length(head) - length(replace(head, ',', '')) AS commas FROM x)
SELECT doc_id, CAST(tabs AS BIGINT) AS tabs, CAST(commas AS BIGINT) AS commas, CASE WHEN tabs >= commas THEN 'tab' ELSE 'comma' END AS delimiter FROM n""")
def delimiter_sniff(spark, sf_dir):
    tabs, commas = delimiter_counts(first_lines(F.col("text")))
    rows = read(spark, sf_dir, "documents").select("doc_id", tabs.cast("long").alias("tabs"), commas.cast("long").alias("commas"))
    return rows.withColumn("delimiter", F.when(F.col("tabs") >= F.col("commas"), "tab").otherwise("comma"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, trim(string_split(line, ',')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS gloss, trim(string_split(line, ',')[2], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS form FROM x)
SELECT doc_id, gloss, form FROM f WHERE gloss <> '' AND form <> ''""")
def parse_lexicon_lines(spark, sf_dir):
    from ..sources.files import parse_lines

    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return parse_lines(lines, ",", "value", "doc_id")
