"""The registered queries opN_<name>: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, conversation_repair, exact_dedup, language_id, merkle, multi_index, packing, pii, secret_scan, setsketch_dedup, suffix_dedup, url_filter, winnowing
from leafmill.llm.common import table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("found")


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4's result: all but the spans that the bootstrapping adds."""
    return op4_personal_data(spark, sf_dir).drop("spans")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit_once(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), model)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5's result: all but the model's own verdicts."""
    judged = op5_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7's result: all but the spans that are confirmed by their structure."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit_text_models(docs))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all four kinds of evidence, on web pages."""
    pages = language_id.page_columns(table(spark, sf_dir, "pages"))
    names = {"id_col": "page_id", "text_col": "_text"}
    models = language_id.fit_text_models(pages, label_col="_declared", **names)
    return language_id.identify(pages, models, declared_col="_declared", host_col="_host", suffix_col="_suffix", **names).withColumnRenamed("doc_id", "page_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_setsketch": op2_setsketch,
    "op3_packing": op3_packing,
    "op4_personal_data": op4_personal_data,
    "personal_data_base": personal_data_base,
    "op5_url_filter": op5_url_filter,
    "url_rules": url_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "secret_scan_base": secret_scan_base,
    "op8_language_id": op8_language_id,
    "page_languages": page_languages,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
    "op11_winnowing": op11_winnowing,
    "op12_merkle": op12_merkle,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The smallest id that links reach, of tables nodes (id) and links (u, v) of both directions.
_REACHED = """
    reached(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.v FROM reached r JOIN links l ON l.u = r.other),
    components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
"""


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """doc_id, counts and base_sha256 from patterns (kind, pattern, condition on a match m).

    Splitting by a pattern gives what stands between its matches, so places are sums of lengths.
    """
    found = []
    for rank, (kind, pattern, good) in enumerate(kinds):
        between = f"string_split_regex(t, '{pattern}')"
        begin = "list_sum(list_transform(between[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:k - 1], lambda x: length(x))), 0)"
        found.append(f"""
            SELECT doc_id, {rank} AS rank, '{kind}' AS kind, matches[k] AS m, ({begin})::BIGINT AS a, ({begin} + length(matches[k]))::BIGINT AS b
            FROM (SELECT doc_id, {between} AS between, regexp_extract_all(t, '{pattern}') AS matches, unnest(range(1, len(matches) + 1)) AS k FROM texts) WHERE {good}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds)
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(found)})
        SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '')) AS base_sha256
        FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id
    """


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT ELSE (2 * {_DIGITS}[-i]::INT) // 10 + (2 * {_DIGITS}[-i]::INT) % 10 END)) % 10 = 0"""
_SECRET = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), xor(c, x))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, x: {step}, 4294967295), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _merkle_levels(tree: str, levels: int) -> str:
    """CTEs of a tree's levels, {tree}0 being (g, i, h, w): node i of w of group g; its runs' sides; rows {tree}_p0 (key, g, i, p, f) folded up."""
    out = []
    for k in range(levels):
        out.append(f"""
        {tree}_s{k} AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM {tree}{k} a JOIN {tree}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.w > 1 GROUP BY a.g, a.i),
        {tree}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN max(w) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (max(w) + 2) // 3 AS w FROM {tree}{k} GROUP BY g, i // 3),
        {tree}_p{k + 1} AS MATERIALIZED (SELECT key, p.g, p.i // 3 AS i, p || coalesce(l || r, '') AS p, CASE WHEN l IS NULL THEN f ELSE sha256(l || f || r) END AS f
          FROM {tree}_p{k} p LEFT JOIN {tree}_s{k} s ON p.g = s.g AND p.i = s.i)""")
    return ",".join(out)


def _merkle() -> str:
    """Levels enough for 3^14 documents of a source and 3^7 sources; the sources' names get a mark so that none is null."""
    rest = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: f"sha256({' || '.join([*rest, _field(text)])})"
    damaged = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    return f"""
        WITH leaves AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, coalesce('s' || source, '') AS g, {leaf("text")} AS h, {leaf(f"({damaged})")} AS f FROM documents),
        a0 AS MATERIALIZED (SELECT key, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, count(*) OVER (PARTITION BY g) AS w, f FROM leaves),
        a_p0 AS (SELECT key, g, i, '' AS p, f FROM a0),{_merkle_levels("a", 14)},
        b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY a14.g) - 1 AS i, h, count(*) OVER () AS w, a14.g AS key FROM a14),
        b_p0 AS (SELECT a_p14.key, 0 AS g, b0.i, p, f FROM a_p14 JOIN b0 ON b0.key = a_p14.g),{_merkle_levels("b", 7)}
        SELECT doc_id, leaves.h AS leaf, a14.h AS subroot, b7.h AS root, sha256(b_p7.p) AS proof_sha256, b_p7.f AS folded_root, b_p7.f = b7.h AS verified
        FROM leaves JOIN b_p7 USING (key) JOIN a14 ON a14.g = leaves.g CROSS JOIN b7
    """


def _conversation_moves() -> str:
    """(state, kind, initial that it needs, edits, state after, cost, lines before, role that it gives) of what may be done to a turn."""
    after, may, needed, names = {"s": 1, "u": 2, "a": 3}, ("su", "u", "a", "u"), "uuau", {"u": "user", "a": "assistant"}
    rows = []
    for state in range(4):
        rows.append((state, "D", "", "D", state, 4, [], ""))
        at, lines = state, []
        for k in range(3):
            rows += [(state, "K", c, "I" * k + "K", after[c], 3 * k, list(lines), "") for c in may[at]]
            rows.append((state, "R", "", "I" * k + "R", after[needed[at]], 3 * k + 3, list(lines), names[needed[at]]))
            lines.append(names[needed[at]] + ":")
            at = after[needed[at]]
    sql = lambda v: "[" + ", ".join(map(sql, v)) + "]::VARCHAR[]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


#: DuckDB SQL.  Tokens (op3, op10), a fitted model's verdicts (op5, op8), bootstrapped (op4) and decoded spans (op7) are beyond
#: it, and op9's 100-byte strings of all texts are too many: those are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_multi_index": f"""
        WITH RECURSIVE nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
        vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95), {_REACHED}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE u = id) AS n_links, component_id, id = component_id AS kept FROM components
    """,
    "op2_setsketch": f"""
        WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
        words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s, len(s) AS n FROM words),
        near AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS shared
                 FROM sets a JOIN sets b ON a.doc_id < b.doc_id AND a.n > 0 AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
        linked AS (SELECT a, b FROM near WHERE 100 * shared >= 80 * (total - shared)),
        links AS (SELECT a AS u, b AS v FROM linked UNION ALL SELECT b, a FROM linked), {_REACHED}
        SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM components JOIN sets ON doc_id = id
    """,
    "personal_data_base": _spans([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ]),
    "secret_scan_base": _spans([
        ("assign", _SECRET + _VALUE, f"length(regexp_extract(m, '{_SECRET}({_VALUE})', 1)) >= 6"),
        # runs under the least length hold no match
        ("access", "AKIA[A-Z0-9]{16,}", "true"),
        ("hex", "[0-9a-f]{24,}", "true"),
    ]),
    "url_rules": r"""
        WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        rules(verdict, rule, domain, prefix) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
          ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/'))
        SELECT page_id, host, path, r.rule, r.verdict FROM parts LEFT JOIN LATERAL (SELECT rule, verdict FROM rules
          WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) ORDER BY length(rule) DESC LIMIT 1) r ON true
    """,
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, arg_max(doc_id, n::HUGEINT * 1000000000000 - doc_id) AS keep_id FROM t GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op11_winnowing": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS c FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
        places AS (SELECT r, i, array_to_string(w[i:i + n - 1], ' ') AS c FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
        hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (c)),
        words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
    """,
    "op12_merkle": _merkle(),
    "op13_conversation_repair": f"""
        WITH RECURSIVE moves(st, kind, needs, letters, st2, price, lines, gives) AS (VALUES {_conversation_moves()}),
        closing(st, price, letters, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])),
        hurt AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS how FROM conversations),
        left_over AS (SELECT c, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM hurt, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE how <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, left(role, 1) AS ini FROM left_over),
        seen AS (SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS twice, ini || lead(ini) OVER (PARTITION BY c ORDER BY i) AS pair FROM placed),
        turns AS (SELECT *, blank OR twice AS gone, NOT blank AND NOT twice AND right(t, 1) NOT IN ('.', '!', '?') AS cut FROM seen),
        best AS (
            SELECT c, 0::BIGINT AS i, 0 AS st, struct_pack(cost := 0::BIGINT, audit := '', lines := []::VARCHAR[]) AS b FROM (SELECT DISTINCT c FROM turns)
            UNION ALL
            SELECT c, i, st2, min(b) FROM (
                SELECT best.c, turns.i, st2, struct_pack(
                    cost := (b.cost + price + CASE WHEN cut AND kind <> 'D' THEN 3 ELSE 0 END)::BIGINT, audit := b.audit || letters,
                    lines := CASE WHEN kind = 'D' THEN b.lines ELSE list_concat(b.lines, moves.lines, [CASE WHEN kind = 'R' THEN gives ELSE role END || ':' || text]) END) AS b
                FROM best JOIN turns ON turns.c = best.c AND turns.i = best.i + 1 JOIN moves ON moves.st = best.st
                WHERE kind = 'D' OR (NOT gone AND (kind = 'R' OR ini = needs))) GROUP BY c, i, st2),
        done AS (SELECT c, min(struct_pack(cost := b.cost + price, audit := b.audit || letters, lines := list_concat(b.lines, closing.lines))) AS b
          FROM best JOIN (SELECT c, max(i) AS n FROM turns GROUP BY c) USING (c) JOIN closing USING (st) WHERE i = n GROUP BY c),
        counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated,
          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY c)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) LEFT JOIN counts USING (c) LEFT JOIN done USING (c)
    """,
}
