"""Registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, decontaminate, embedding_dedup, jaccard_join, licenses, line_dedup, merkle_manifest, periodic_runs, pii
from quern.llm import sentencepiece_scan, substring_dedup, toxicity, warc_audit
from quern.session import Tables

TOKENIZER = os.environ.get("QUERN_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
RANKS = os.environ.get("QUERN_BYTE_BPE_RANKS", public_tokenizers.path("byte_bpe_50k.tiktoken"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda spark, d: licenses.scan(Tables(spark, d).documents),
    "op2_sentencepiece_scan": lambda spark, d: sentencepiece_scan.token_report(Tables(spark, d).documents, TOKENIZER),
    "op3_toxicity": lambda spark, d: toxicity.toxicity_scores(Tables(spark, d).documents, Tables(spark, d).labels),
    "op4_warc_audit": lambda spark, d: warc_audit.pages_audit(Tables(spark, d).pages),
    "op5_substring_dedup": lambda spark, d: substring_dedup.substring_report(Tables(spark, d).documents),
    "op6_line_dedup": lambda spark, d: line_dedup.line_report(Tables(spark, d).documents),
    "op7_embedding_dedup": lambda spark, d: embedding_dedup.vector_report(Tables(spark, d).embeddings),
    "op8_pii_disclosure": lambda spark, d: pii.pii_report(Tables(spark, d).documents),
    "op9_decontamination": lambda spark, d: decontaminate.contaminated(Tables(spark, d).documents, Tables(spark, d).benchmark),
    "op10_jaccard_join": lambda spark, d: jaccard_join.jaccard_report(Tables(spark, d).documents),
    "op11_byte_bpe": lambda spark, d: byte_bpe.token_report(Tables(spark, d).documents, RANKS, public_tokenizers.PATTERN),
    "op12_merkle_manifest": lambda spark, d: merkle_manifest.manifest_report(Tables(spark, d).documents),
    "op13_periodic_runs": lambda spark, d: periodic_runs.run_report(Tables(spark, d).documents),
}

_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _reach(nodes: str, links: str) -> str:
    """Common table expressions: smallest node reachable over symmetric ``links(a, b)``."""
    return f"""reach AS (
        SELECT id, id AS other FROM {nodes}
        UNION
        SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
    parts AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def _license_sql() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in licenses.SENTENCES.items())
    steps, last = [], "joined"
    for k, (name, parts) in enumerate(licenses.RULES):
        # without look-ahead: a following space is part of the match and put back
        pattern = licenses.rule_pattern(parts).replace("(?= |$)", "( |$)")
        steps.append(f"""r{k} AS (SELECT doc_id, n_sentences, sentence_ids,
            CASE WHEN regexp_matches(rest, {_quoted(pattern)}) AND NOT list_contains(named, {_quoted(name)}) THEN list_append(named, {_quoted(name)}) ELSE named END AS named,
            regexp_replace(regexp_replace(rest, {_quoted(pattern)}, ' |\\1', 'g'), {_quoted(pattern)}, ' |\\1', 'g') AS rest FROM {last})""")
        last = f"r{k}"
    return f"""
    WITH known(sentence, known_id) AS (VALUES {known}),
    cut AS (SELECT rowid AS row, doc_id, string_split_regex(
              regexp_replace(coalesce(text, ''), {_quoted(licenses.WRAP)}, '\\1 \\2', 'g'), {_quoted(licenses.CUT)}) AS s
            FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
    parts AS (SELECT row, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM cut),
    named AS (SELECT row, pos, known_id FROM (
                SELECT row, pos, regexp_replace(trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')), {_quoted(licenses.HOLDER)}, '\\1') AS sentence FROM parts)
              JOIN known USING (sentence)),
    joined AS (SELECT doc_id, count(known_id) AS n_sentences, coalesce(string_agg(known_id, ' ' ORDER BY pos), '') AS sentence_ids,
                 CAST([] AS VARCHAR[]) AS named, CASE WHEN count(known_id) > 0 THEN ' ' || string_agg(known_id, ' ' ORDER BY pos) ELSE '' END AS rest
               FROM cut LEFT JOIN named USING (row) GROUP BY row, doc_id),
    {", ".join(steps)}
    SELECT doc_id, n_sentences, sentence_ids, array_to_string(named, ',') AS licenses,
           array_to_string(list_filter(string_split(trim(rest), ' '), lambda x: x NOT IN ('|', '')), ' ') AS unmatched FROM {last}"""


def _manifest_sql(height: int = 16) -> str:
    """Levels and climbs written out, up to ``3 ** height`` rows in a source and as many sources."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def level(name: str, k: int) -> str:
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest,
            (n + 2) // 3 AS n FROM {name}{k} GROUP BY tree, n, pos // 3)"""

    def climb(name: str, k: int, before: str) -> str:
        return f"""r_{name}{k} AS MATERIALIZED (SELECT tree, n, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM {name}{k} GROUP BY ALL),
        c_{name}{k} AS MATERIALIZED (SELECT doc_id, leaf, subtree, c.tree, pos // 3 AS pos,
            CASE WHEN n > 1 THEN sha256(array_to_string(list_transform(ds, lambda d, i: CASE WHEN i - 1 = pos % 3 THEN folded ELSE d END), '')) ELSE folded END AS folded,
            CASE WHEN n > 1 THEN proof || array_to_string(list_filter(ds, lambda d, i: i - 1 <> pos % 3), '') ELSE proof END AS proof
            FROM {before} c JOIN r_{name}{k} r ON r.tree = c.tree AND r.run = pos // 3)"""

    # crc32 bit by bit: a byte is xored in, then eight shifts (-1); even where the register ends in 1
    crc = """list_reduce(flatten([[4294967295]] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT] || [-1 for i in range(8)])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
    steps = [level("l", k) for k in range(height)]
    steps.append(f"t0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS n FROM l{height})")
    steps += [level("t", k) for k in range(height)]
    before = "start"
    for k in range(height):
        steps.append(climb("l", k, before))
        before = f"c_l{k}"
    steps.append(f"above AS (SELECT doc_id, leaf, subtree, 0 AS tree, subtree AS pos, folded, proof FROM {before})")
    before = "above"
    for k in range(height):
        steps.append(climb("t", k, before))
        before = f"c_t{k}"
    return f"""
    WITH marked AS (SELECT *, CASE WHEN {crc} & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
    leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS claimed FROM marked),
    placed AS MATERIALIZED (SELECT doc_id, leaf, claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
    l0 AS MATERIALIZED (SELECT tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed),
    start AS (SELECT doc_id, leaf, tree AS subtree, tree, pos, claimed AS folded, '' AS proof FROM placed),
    {", ".join(steps)}
    SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
    FROM {before} c JOIN l{height} s ON s.tree = c.subtree JOIN t{height} r ON r.tree = 0"""


SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op4_warc_audit": """
    WITH record AS (SELECT page_id, octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))
           || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS bytes FROM pages),
    placed AS (SELECT page_id, bytes, sum(bytes) OVER (PARTITION BY page_id // 65536 ORDER BY page_id) AS upto FROM record)
    SELECT page_id, CAST(upto - bytes AS BIGINT) AS start_offset, CAST(upto AS BIGINT) AS end_offset,
           CASE WHEN page_id % 97 = 1 THEN 'missing' ELSE 'altered' END AS verdict
    FROM placed WHERE page_id % 97 IN (0, 1, 2)""",
    "op5_substring_dedup": r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS p FROM words WHERE len(w) >= 50),
    windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS seen FROM starts JOIN words USING (doc_id)),
    least AS (SELECT seen, min(doc_id) AS first FROM windows GROUP BY seen),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS pos FROM windows JOIN least USING (seen) WHERE doc_id > first),
    each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
    kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS text, count(*) AS n
             FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.doc_id IS NULL GROUP BY e.doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)""",
    "op6_line_dedup": f"""
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
    lines AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM cut),
    keyed AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
    repeated AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    judged AS (SELECT doc_id, line, pos, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id""",
    "op7_embedding_dedup": f"""
    WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
    {_reach("v", "links")},
    counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept
    FROM parts LEFT JOIN counts USING (id)""",
    "op10_jaccard_join": rf"""
    WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT id, unnest(generate_series(1, greatest(1, len(w) - 4))) AS p FROM words WHERE len(w) > 0),
    sets AS (SELECT DISTINCT id, md5(array_to_string(w[p:p + 4], ' ')) AS g FROM starts JOIN words USING (id)),
    sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
    shared AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM sets x JOIN sets y ON x.g = y.g AND x.id <> y.id GROUP BY x.id, y.id),
    links AS (SELECT a, b FROM shared JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE 100 * common >= 80 * (s.n + t.n - common)),
    {_reach("words", "links")}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM parts LEFT JOIN sizes USING (id)""",
    "op12_merkle_manifest": _manifest_sql(),
}
