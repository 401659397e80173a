"""Tables of contents, runs of references, and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, refs
from ..registry import register
from ..sources import toc
from ..sources.workspace import shared_folder, stored
from . import duck, rel, spread

_ITEM = '<li><div class="isrb-tree-item">{0}</div>{1}</li>'
_LINK = '<li><div class="contextual-region"><span><a href="#">{0}</a></span></div></li>'


def _lists() -> str:
    """SQL for a page of nested lists: what changes from part to part is between quotes and bars."""
    inner = _LINK.format("Article '||p_size||' a: Own  rules of '||p_name||'") + _LINK.format("no article") + _ITEM.format("Sub-section 1: narrower", "<ul>" + _LINK.format("Article '||(p_size + 1)||': Second") + "</ul>")
    chapter = _ITEM.format("CHAPTER '||(p_size % 7)||' - scope", "<ul>" + _ITEM.format("Section '||(p_size % 3)||': part", f"<ul>{inner}</ul>") + _LINK.format("Article '||(p_size + 2)||': Third") + "</ul>")
    part = _ITEM.format("PART THREE: capital", "<ul>" + _ITEM.format("Title iv: funds", f"<ul>{chapter}</ul>") + _LINK.format("Article '||(p_size + 3)||': Fourth") + "</ul>")
    page = f'<html><ul><li>menu</li></ul><div id="block-isrb-tree"><ul>{part}{_LINK.format("Annex ii: Forms of "+chr(39)+"||p_name||"+chr(39))}</ul></div></html>'
    return "SELECT p_partkey AS page_id, concat('" + page.replace("'||", "', CAST(").replace("||'", " AS STRING), '") + "') AS html FROM {part}"


_PAGES = _lists()


@register(
    "toc_entries",
    """WITH e AS (SELECT p_partkey AS page_id, p_size, p_name, unnest(range(5))::INTEGER AS pos FROM part)
SELECT page_id, pos, CASE pos WHEN 0 THEN p_size || 'a' WHEN 1 THEN (p_size + 1)::VARCHAR WHEN 2 THEN (p_size + 2)::VARCHAR WHEN 3 THEN (p_size + 3)::VARCHAR ELSE 'ANNEX_II' END AS article,
 CASE pos WHEN 0 THEN 'Own rules of ' || p_name WHEN 1 THEN 'Second' WHEN 2 THEN 'Third' WHEN 3 THEN 'Fourth' ELSE 'Forms of ' || p_name END AS article_title, CASE WHEN pos < 4 THEN 'THREE' ELSE '' END AS part, CASE WHEN pos < 3 THEN 'IV' ELSE '' END AS title,
 CASE WHEN pos < 3 THEN (p_size % 7)::VARCHAR ELSE '' END AS chapter, CASE WHEN pos < 2 THEN (p_size % 3)::VARCHAR ELSE '' END AS section, pos = 4 AS is_annex, CASE WHEN pos = 1 AND p_size % 2 = 0 THEN 'terms ' || p_size ELSE '' END AS key_terms FROM e""",
)
def toc_entries(spark, sf):
    terms = rel(spark, sf, "SELECT DISTINCT CAST(p_size + 1 AS STRING) AS article, concat('terms ', CAST(p_size AS STRING)) AS key_terms, p_size FROM {part}").where("p_size % 2 = 0").drop("p_size")
    # Written, so that its true size is known: entries are not shuffled to meet it. Pages are parsed once, for all places.
    terms = stored(terms, shared_folder(spark, "terms"))
    # One page's own terms: an article's number stands for another part on another page.
    return toc.with_key_terms(toc.entries(spread(rel(spark, sf, _PAGES))), terms, F.col("pos") == 1)


_RUNS = """SELECT p_partkey AS id, concat('See ', CASE p_size % 3 WHEN 0 THEN 'Article ' WHEN 1 THEN 'articles ' ELSE 'Articolo  ' END, CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN ', 7a and 9' WHEN 1 THEN ' e 12' ELSE '' END,
 CASE p_partkey % 5 WHEN 0 THEN ' of Regulation (EU) No 1' WHEN 1 THEN ' to 14 of Directive 2' WHEN 2 THEN ' della Direttiva 3' ELSE ' on ' END, p_name, CASE WHEN p_partkey % 2 = 0 THEN ' or Article 4' ELSE '.' END) AS text FROM {part}"""
_RUN, _ACT = r"(?i)\b(?:Articles?|Articol[oi])\s+\d\w*(?:\s*(?:,|and|e|or|o)\s+\d\w*)*", r"(?i)^\s*(?:(?:to\s+\d\w*\s+)?of|del(?:la|lo|l'')?)\s+(?:Regulation|Directive|Decision|Delegated|Implementing|Regolamento|Direttiva|Decisione)"


@register(
    "reference_runs",
    f"""WITH t AS ({duck(_RUNS)}), p AS (SELECT id, text, regexp_extract_all(text, '{_RUN}') AS f, regexp_split_to_array(text, '{_RUN}') AS b FROM t),
i AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM p),
r AS (SELECT id, i, 0 AS j, b[i] AS s, 0 AS k, false AS n FROM i UNION ALL
 SELECT id, i, 1, f[i], 0, false FROM i WHERE i < len(b) AND regexp_matches(b[i + 1], '{_ACT}') UNION ALL
 SELECT id, i, 1, unnest(regexp_split_to_array(f[i], '\\d\\w*')), 2 * generate_subscripts(regexp_split_to_array(f[i], '\\d\\w*'), 1), false FROM i WHERE i < len(b) AND NOT regexp_matches(b[i + 1], '{_ACT}') UNION ALL
 SELECT id, i, 1, unnest(regexp_extract_all(f[i], '\\d\\w*')), 2 * generate_subscripts(regexp_extract_all(f[i], '\\d\\w*'), 1) + 1, true FROM i WHERE i < len(b) AND NOT regexp_matches(b[i + 1], '{_ACT}')),
o AS (SELECT id, CASE WHEN n THEN 'article' ELSE 'text' END AS kind, s AS value, row_number() OVER w - 1 AS run, coalesce(sum(len(s)) OVER (PARTITION BY id ORDER BY i, j, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r WHERE s <> '' WINDOW w AS (PARTITION BY id ORDER BY i, j, k))
SELECT id, run::INTEGER AS run, kind, value, start::INTEGER AS start FROM o""",
)
def reference_runs(spark, sf):
    runs = rel(spark, sf, _RUNS).select("id", F.posexplode(refs.reference_runs(F.col("text"))).alias("run", "r"))
    return runs.select("id", "run", "r.kind", "r.value", "r.start")


_OLD_RUN, _OLD_ACT = r"(?i)Articles?\s+\d+[a-z]?", r"(?i)^\s+(?:to\s+\d\w*\s+)?(?:of|del(?:la|lo|l'')?)\s+(?:Regulation|Directive|Decision|Delegated|Implementing|Regolamento|Direttiva|Decisione|Rozporządzenie|Dyrektywa|Decyzja)"


@register(
    "single_refs",
    f"""WITH t AS ({duck(_RUNS)}), p AS (SELECT id, regexp_extract_all(text, '{_OLD_RUN}') AS f, regexp_split_to_array(text, '{_OLD_RUN}') AS b FROM t),
i AS (SELECT id, f, b, unnest(range(1, len(f) + 1)) AS i FROM p), n AS (SELECT DISTINCT id, regexp_extract(f[i], '([0-9]+[a-zA-Z]?)$', 1) AS a FROM i WHERE NOT regexp_matches(b[i + 1], '{_OLD_ACT}'))
SELECT t.id, coalesce(string_agg(a, ',' ORDER BY regexp_extract(a, '^([0-9]+)', 1)::BIGINT, a), '') AS refs FROM t LEFT JOIN n USING (id) GROUP BY t.id""",
)
def single_refs(spark, sf):
    return rel(spark, sf, _RUNS).select("id", F.array_join(refs.single_refs(F.col("text")), ",").alias("refs"))


_PLAIN = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"


@register(
    "language_identify",
    f"""WITH t AS (SELECT doc_id, lang AS language, {_PLAIN} AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, language, substr(t, unnest(range(1, len(t) - 1)), 3) AS gram FROM t),
c AS (SELECT language, gram, count(*) AS c FROM g WHERE doc_id % 5 <> 0 AND language IS NOT NULL GROUP BY ALL), total AS (SELECT language, sum(c) AS total FROM c GROUP BY language),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY language ORDER BY c DESC, gram) <= 500),
pr AS (SELECT language, gram, round(1000000 * ln((c + 1) / (total + 500)::DOUBLE))::BIGINT AS weight FROM top JOIN total USING (language)),
un AS (SELECT language, round(1000000 * ln(1 / (total + 500)::DOUBLE))::BIGINT AS unseen FROM total),
d AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), z AS (SELECT doc_id, sum(c) AS n FROM d GROUP BY doc_id),
ga AS (SELECT doc_id, language, sum(c * (weight - unseen)) AS gain FROM d JOIN pr USING (gram) JOIN un USING (language) GROUP BY ALL),
s AS (SELECT doc_id, language, (unseen * n + coalesce(gain, 0))::BIGINT AS score FROM z CROSS JOIN un LEFT JOIN ga USING (doc_id, language))
SELECT doc_id, language, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1""",
)
def language_identify(spark, sf):
    """Each document's language by profiles that are learned from four fifths of the labelled ones."""
    docs = rel(spark, sf, "SELECT doc_id, lang AS language, text FROM {documents}")
    return language.identify(docs, language.fit(docs.where("doc_id % 5 <> 0")))

