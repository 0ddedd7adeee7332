"""What SQL says to the queries it can express, for DuckDB."""

from __future__ import annotations

from meterline.llm.chat import CONTROL, END, TEXT, TURN
from meterline.llm.licences import HINT, NO_WORD, RULES, SENTENCE_END, SENTENCES, VERSION
from meterline.llm.secret_scan import ISSUED


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    escaped = " + ".join(
        f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, {_quoted(CONTROL)}))"
        for c in ("role", "text"))
    marks = len(TURN) + len(TEXT) + len(END)
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized AS (
        SELECT *, sum({marks} + {escaped}) OVER w AS upto,
            row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
        FROM turns
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR is_last), 0) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """


_TILES = """
    WITH RECURSIVE vectors AS (
        SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
            list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    ), usable AS (
        SELECT r, vec_id, label, v FROM vectors
        WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(v, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.r AS a, b.r AS b, b.vec_id FROM usable a JOIN usable b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.98
    ), reach(a, b) AS (
        SELECT r, r FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), smallest AS (
        SELECT reach.a AS r, min(vectors.vec_id) AS component_id FROM reach JOIN vectors ON reach.b = vectors.r GROUP BY reach.a
    ), degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
        vec_id IS NOT DISTINCT FROM component_id AS kept
    FROM vectors JOIN smallest USING (r) LEFT JOIN degree USING (r)
"""

_EXACT = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _secrets() -> str:
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("issued", ISSUED, 0, 1)]
    found = " UNION ALL ".join(f"""
        SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, length(value) AS size, starts + length(whole) - length(value) AS "from",
            starts AS start, starts + length(whole) AS "end", value
        FROM (
            SELECT doc_id, owner, unnest(m) AS whole, unnest(v) AS value,
                unnest(list_transform(range(1, len(m) + 1), lambda i:
                    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS starts
            FROM (
                SELECT doc_id, source AS owner, regexp_extract_all(text, {_quoted(p)}, 0) AS m,
                    regexp_extract_all(text, {_quoted(p)}, {group}) AS v, string_split_regex(text, {_quoted(p)}) AS g
                FROM texts WHERE regexp_matches(text, {_quoted("[0-9a-f]{24,}" if kind == "hex" else p)}))
        ) WHERE length(value) >= {least}""" for rank, (kind, p, group, least) in enumerate(kinds))
    return f"""
    WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    shared AS (
        SELECT value, count(DISTINCT coalesce('=' || owner, '-')) >= 3 OR count(DISTINCT coalesce('=' || doc_id, '-')) >= 10 AS example
        FROM found GROUP BY value
    ), judged AS (
        SELECT found.*, example, NOT example AND length(value) >= 16 AND regexp_matches(value, '[0-9]')
            AND regexp_matches(value, '[A-Za-z]') AS live
        FROM found JOIN shared USING (value)
    ), spans AS (
        SELECT doc_id, rank, kind, start, "end" FROM found WHERE kind <> 'issued'
        UNION ALL SELECT DISTINCT doc_id, 3, 'live', "from", "end" FROM judged WHERE live
    ), listed AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live,
            string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") FILTER (kind <> 'live') AS base,
            string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS spans
        FROM spans GROUP BY doc_id
    ), examples AS (SELECT doc_id, count(*) FILTER (example) AS n_example FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM texts LEFT JOIN listed USING (doc_id) LEFT JOIN examples USING (doc_id)
    """


def _licences() -> str:
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in SENTENCES.items()) + "}"
    steps, rest = [], "ids"
    columns = []
    for i, (name, sequence) in enumerate(RULES):
        pattern = _quoted("".join(rf"\|{identifier}@([^|]*)\|" for identifier in sequence))
        before = "s" if i == 0 else f"s{i - 1}"
        steps.append(f"""t{i} AS (SELECT *, regexp_replace({before}, {pattern}, '||', 'g') AS s{i},
            list_transform(regexp_extract_all({before}, {pattern}, 1), lambda v: replace({_quoted(name)}, '@', v)) AS f{i}
            FROM {'t' if i == 0 else f't{i - 1}'})""")
        columns.append(f"f{i}")
    gathered = f"flatten([{', '.join(columns)}])"
    return f"""
    WITH cut AS (
        SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {_quoted(HINT)}) THEN list_transform(
            string_split_regex(regexp_replace(text, {_quoted(SENTENCE_END)}, chr(10), 'g'), '[\\n\\r]+'),
            lambda x: {{'norm': trim(regexp_replace(regexp_replace(lower(x), {_quoted(VERSION)}, '#', 'g'), {_quoted(NO_WORD)}, ' ', 'g')),
                   'version': regexp_extract(x, {_quoted(VERSION)}, 0)}}) ELSE [] END AS sentences
        FROM documents
    ), named AS (
        SELECT doc_id, list_filter(list_transform(sentences,
            lambda x: {known}[x.norm] || '@' || x.version), lambda x: x IS NOT NULL) AS ids FROM cut
    ), t AS (
        SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
            '|' || replace(coalesce(array_to_string(ids, ' '), ''), ' ', '||') || '|' AS s FROM named
    ), {', '.join(steps)}
    SELECT doc_id, sentence_ids, coalesce(array_to_string(list_sort(list_distinct({gathered})), ' '), '') AS licences
    FROM t{len(RULES) - 1}
    """


_NEGATIVES = """
    WITH whole AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
        FROM whole a, whole c WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs
        WHERE label = anchor_label AND vec_id <> anchor_id
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
"""


def _repair() -> str:
    """A table of the least cost and edits from every row and state on, made from the last row to the first."""
    def put(role: str, rest: str) -> str:
        return f"{{'c': {rest}.c + 3, 'a': 'I' || {rest}.a, 't': '{role}:' || chr(10) || {rest}.t}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def closed(g: str) -> str:
        from_start = put("user", f"{g}[3]"), put("user", f"({put('assistant', f'{g}[4]')})")
        return ", ".join((least(f"{g}[1]", *from_start), least(f"{g}[2]", *from_start),
                          least(f"{g}[3]", put("assistant", f"{g}[4]")), least(f"{g}[4]", put("user", f"{g}[3]"))))

    never = "{'c': 1000000, 'a': '', 't': ''}"
    line = "|| ':' || r.text || chr(10) ||"
    extra = "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    steps = []
    for state, (kept, role, after) in enumerate((
            ({"s": 2, "u": 3}, "user", 3), ({"u": 3}, "user", 3), ({"a": 4}, "assistant", 4), ({"u": 3}, "user", 3)), 1):
        ways = [f"{{'c': f[{state}].c + 4, 'a': 'D' || f[{state}].a, 't': f[{state}].t}}",
                f"CASE WHEN fault IN (1, 2) THEN {never} ELSE {{'c': f[{after}].c + 3 + {extra}, 'a': 'R' || f[{after}].a, 't': '{role}' {line} f[{after}].t}} END"]
        ways += [f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN {{'c': f[{to}].c + {extra}, 'a': 'K' || f[{to}].a, 't': r.role {line} f[{to}].t}} ELSE {never} END"
                 for initial, to in kept.items()]
        steps.append(least(*ways))
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), "
           "lambda i: [CAST(ord(k[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)")
    given = "{'c': 0, 'a': '', 't': ''}"
    return f"""
    WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), fated AS (SELECT *, {crc} % 20 AS fate FROM named), damaged AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM fated, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) WHERE fate <> 0
    ), placed AS (
        SELECT *, row_number() OVER w AS pos, role[1] AS initial, lag(role[1]) OVER w AS before,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\\z', 1) AS last_char
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), coded AS (
        SELECT *, CASE WHEN last_char = '' THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN last_char NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
        FROM placed
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM coded GROUP BY conv_id
    ), each AS (
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted o ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    ), walk AS (
        SELECT conv_id, n AS i, [{closed(f"[{given}, {never}, {never}, {given}]")}] AS f FROM each
        UNION ALL
        SELECT conv_id, i - 1, [{closed("g")}] FROM (
            SELECT w.conv_id, i, [{', '.join(steps)}] AS g
            FROM walk w JOIN coded r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.i
        )
    )
    SELECT e.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(f[1].c AS BIGINT) AS cost,
        f[1].a AS audit, sha256(left(f[1].t, greatest(length(f[1].t) - 1, 0))) AS repaired_sha256
    FROM each e JOIN walk w ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND i = 0
    """


SQL = {
    "op1_chat_formatting": _chat(),
    "op6_embedding_dedup": _TILES,
    "op7_exact_dedup": _EXACT,
    "op8_secret_scan": _secrets(),
    "op9_licence_scan": _licences(),
    "op11_conversation_repair": _repair(),
    "op12_hard_negatives": _NEGATIVES,
}
