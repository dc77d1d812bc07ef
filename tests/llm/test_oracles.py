"""The SQL twins say what the brute-force restatements say."""

import brute
import duckdb
import pytest
from conftest import SF
from test_infill import restate, sha
from test_trie import plain_trie

from pagegraph.llm.oracles import ORACLES


def infilled(docs):
    found = [(i, t or "", restate(i, t)) for i, t in docs]
    return [(i, *cut[:-1], sha(cut[-1]), sha(t)) for i, t, cut in found]


PLAIN = {
    "op1_topk": lambda t: brute.topk(t("SELECT vec_id, embedding FROM embeddings")),
    "op4_neardup": lambda t: brute.vector_links(t("SELECT vec_id, embedding, label FROM embeddings")),
    "op7_jaccard": lambda t: brute.shingle_classes(t("SELECT doc_id, text FROM documents")),
    "op8_warc": lambda t: brute.warc(t("SELECT page_id, html FROM pages")),
    "op11_infill": lambda t: infilled(t("SELECT doc_id, text FROM documents")),
    "op13_trie": lambda t: plain_trie(t("SELECT conv_id, turn, role, text FROM conversations")),
    "op9_substring": lambda t: brute.substring_dedup(t("SELECT doc_id, text FROM documents")),
}

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_equals_brute_force(name):
    con = duckdb.connect()
    for table in ("embeddings", "documents", "pages", "conversations"):
        con.execute("CREATE VIEW {0} AS SELECT * FROM '{1}/{0}.parquet'".format(table, SF))
    found = sorted(con.execute(ORACLES[name]).fetchall(), key=str)
    assert found == sorted(PLAIN[name](lambda sql: con.execute(sql).fetchall()), key=str)
