"""The registered queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.llm.embed_dedup import near_vectors
from quadrille.llm.exact_dedup import exact_report
from quadrille.llm.language_id import language_report
from quadrille.llm.license_scan import license_report
from quadrille.llm.ngram_join import jaccard_links, jaccard_report
from quadrille.llm.packing import pack
from quadrille.llm.secrets import secret_report
from quadrille.llm.sentencepiece_codec import encode_pieces
from quadrille.llm.shared import read_table
from quadrille.llm.token_files import token_file_report
from quadrille.llm.url_filter import judge_urls


def _over(table, operator):
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))


def queries():
    return {
        "op1_secret_scan": _over("documents", secret_report),
        "op2_exact_dedup": _over("documents", exact_report),
        "op3_packing": _over("documents", pack),
        "op4_embedding_near_dedup": _over("embeddings", near_vectors),
        "op5_ngram_jaccard": _over("documents", jaccard_report),
        "op6_language_id": _over("documents", language_report),
        "op7_token_files": _over("documents", token_file_report),
        "op8_url_filter": _over("pages", judge_urls),
        "op9_license_scan": _over("documents", license_report),
        "op10_sentencepiece": _over("documents", encode_pieces),
        # the columns of op1, op8 and op9 that SQL can say, through the same operators
        "secret_counts": _over("documents", lambda docs: secret_report(docs).select("doc_id", "n_assign", "n_access", "n_hex")),
        "url_rules": _over("pages", lambda pages: judge_urls(pages).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))),
        # every link of op5's join, not only a set of them that connects the classes
        "ngram_links": _over("documents", jaccard_links),
        "license_places": _over("documents", lambda docs: license_report(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")),
    }


def oracle_sql():
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # 4-word shingles, pairs that link, what is reachable
    shingles = rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        r AS (SELECT doc_id AS id, doc_id AS node FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.node = l.a),
        c AS (SELECT id, min(node) AS component_id FROM r GROUP BY id),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)"""
    # group_size, lengths and digests are all that SQL needs for exact duplicates; the others learn or tokenise
    return {
        "op2_exact_dedup": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
        """,
        "op4_embedding_near_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CAST(x IS NULL OR NOT isfinite(x) AS INT)), 'max') = 0
                  AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
            r AS (SELECT vec_id AS id, vec_id AS node FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.node = l.a),
            c AS (SELECT id, min(node) AS component_id FROM r GROUP BY id),
            n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
            SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
            FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
        """,
        "op5_ngram_jaccard": f"{shingles} SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents JOIN c ON doc_id = id LEFT JOIN n USING (doc_id)",
        "ngram_links": f"{shingles} SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents JOIN c ON doc_id = id LEFT JOIN n USING (doc_id) LEFT JOIN k ON doc_id = a",
        "secret_counts": r"""
            SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
                   len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
                   len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
            FROM documents
        """.replace("\\'", "''"),
        "url_rules": f"""
            WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            k(kind, dom, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
            f AS (SELECT page_id, arg_max(dom || pre, length(dom || pre)) AS rule, arg_max(kind, length(dom || pre)) AS by_rule FROM h JOIN k ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre) GROUP BY page_id)
            SELECT page_id, host, path, rule, by_rule FROM h LEFT JOIN f USING (page_id)
        """,
        "license_places": rf"""
            WITH w AS (SELECT doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, '[0-9a-z\x80-\x{{10FFFF}}]+') AS w FROM documents),
            p AS (SELECT doc_id, len(w) AS n, unnest(['cc-by', 'gpl', 'reserved']) AS label,
                         unnest([list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by'), list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'),
                                 list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved')]) AS at_word FROM w)
            SELECT doc_id, n AS n_words, CAST(sum(len(at_word)) AS BIGINT) AS n_base, min(list_min(at_word)) AS first_word, max(list_max(at_word)) AS last_word,
                   coalesce(string_agg(label, ',' ORDER BY label) FILTER (len(at_word) > 0), '') AS base_labels FROM p GROUP BY doc_id, n
        """,
    }
