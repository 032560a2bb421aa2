"""Queries that take whole tables where their registered SQL still has a cut, against SQL without it.

The registered SQL is left as it is. Each case names the piece of it that cuts and what stands there
instead, so that the difference can be read; the last ones have SQL of their own.
"""

import os

import pytest

from quire.plans import measure_queries, registry, text_queries
from tests.test_queries import FOLDER, compare, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

HOLDER = (" WHERE author <> 'A9000000000'", "")
WORDS = f"list_filter(regexp_extract_all(lower(X), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({measure_queries._stop}))"
ABSTRACT = WORDS.replace("X", "abstract")
PAIRS = f"list_transform(range(1, greatest(1, len({ABSTRACT}))), lambda i: ({ABSTRACT})[i] || ' ' || ({ABSTRACT})[i + 1])"
TERMS = [
    (WORDS.replace("X", "title"), f"list_concat({ABSTRACT}, {PAIRS})"),
    (" WHERE term IN (SELECT term FROM t0 GROUP BY term HAVING count(*) <= 60)", ""),
    (" WHERE term IN (SELECT term FROM c0 GROUP BY term HAVING count(*) <= 60)", ""),
]
BY_AUTHOR = ("coauthor_edges", "strong_collaborations", "collaboration_degrees", "coauthor_components", "author_citation_paths", "topic_experts", "h_index", "career_spans")
BY_TERMS = ("lexical_ranking", "fused_ranking", "recall", "precision", "union_of_rankings", "boolean_search", "expanded_search", "community_ranking")
EDITS = {
    **dict.fromkeys(BY_AUTHOR, [HOLDER]),
    "similar_topics": [(" WHERE c IN (SELECT c FROM k0 GROUP BY c HAVING count(*) <= 100)", "")],
    "rare_bridges": [("c IN (SELECT c FROM k GROUP BY c HAVING count(*) <= 30)", "c NOT IN (SELECT c FROM k GROUP BY c ORDER BY count(*) DESC, c LIMIT 50)")],
    **dict.fromkeys(BY_TERMS, TERMS),
}
# scripts, comments, templates (twice, for nested ones), links and tags, as the query strips them
STRIPPED = r"""
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
        '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '\{\{[^{}]*\}\}', ' ', 'g'),
        '\{\{[^{}]*\}\}', ' ', 'g'), '\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]', '\1', 'g'), '<[^>]+>', ' ', 'g'), '''{2,}', '', 'g')
"""
WHOLE = {
    "decision_precedence": """SELECT candidate_id, source, value FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
        ORDER BY CASE source WHEN 'atlas-judge' THEN 3 WHEN 'borea-judge' THEN 2 WHEN 'cinder-judge' THEN 1 ELSE -1 END DESC, value DESC NULLS LAST, source DESC) AS rn
        FROM (SELECT candidate_id, nullif(lower(trim(judge)), '') AS source, max(bridge_validity) AS value FROM judgements WHERE parse_ok GROUP BY 1, 2) WHERE source IS NOT NULL) WHERE rn = 1""",
    "plain_pages": f"SELECT doc_id, md5({text_queries._blank('t')}) AS digest FROM (SELECT doc_id, replace(replace({STRIPPED}, '&nbsp;', ' '), '&amp;', '&') AS t FROM documents)",
}


@pytest.mark.parametrize("name", sorted(EDITS))
def test_query_equals_its_sql_without_the_cut(spark, duck, name):  # noqa: F811
    sql = registry.oracle_sql()[name]
    for cut, instead in EDITS[name]:
        sql = sql.replace(cut, instead)
    assert sql != registry.oracle_sql()[name]
    compare(spark, duck, registry.queries()[name], sql)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_equals_whole_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, registry.queries()[name], WHOLE[name])
