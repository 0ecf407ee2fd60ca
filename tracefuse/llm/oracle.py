"""DuckDB SQL of the queries that SQL can express.

No SQL: op1 (tokenizer merges), op2 (block rules over markup), op5 (banded
alignment), op6 (a trained network), op8 (XXH64), op9 (Kneser-Ney tables),
pipeline; tests/llm holds them against brute force.  The SQL engine has no CRC
function, so CRCs (op10, op12, op13) are spelled out byte by byte.  op12's near
words are found by what is left when one letter is taken out.
"""

from __future__ import annotations

from tracefuse.llm import conversation, licenses, line_dedup, line_rules, sharding, spelling, warc
from tracefuse.llm.queries import SHARDS

WORDS = r"'[^\x20\x09-\x0D]+'"


SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CRC_TABLE = """crc_table AS (
  SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1
         THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)),
tab AS (SELECT list(v ORDER BY n) AS t FROM crc_table)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text in UTF-8; needs CRC_TABLE's ``tab`` in the FROM clause."""
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {of_bytes}), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))")


def line_dedup_sql() -> str:
    key = f"translate(trim(line, {SPACES}), '{licenses.UPPER}', '{licenses.UPPER.lower()}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT row_no, doc_id, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT row_no, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM cut),
keyed AS (SELECT *, {key} AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k
          HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) >= {line_dedup.MIN_DOCS}),
marked AS (SELECT keyed.*, often.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM keep_id AS gone
           FROM keyed LEFT JOIN often ON often.k = keyed.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no"""


def spelling_sql() -> str:
    run = r"'[A-Za-z\x{C0}-\x{FF}]+'"
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d,
                unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}'), {run})) AS w
         FROM documents),
counted AS (SELECT d, w, count(*) AS n FROM runs GROUP BY d, w),
drawn AS (SELECT w, n, {crc_sql("d || ':' || w")} AS h FROM counted, tab),
damaged AS (SELECT CASE WHEN h % {spelling.MODULUS} = 0
                        THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n
            FROM drawn),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {spelling.MIN_LETTERS}
          GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
replaced AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
shorter AS (SELECT DISTINCT less.word AS a, less.n AS a_n, words.word AS b, words.n AS b_n FROM less JOIN words ON words.word = less.rest),
near AS (SELECT DISTINCT a, b, n FROM (SELECT * FROM replaced UNION ALL SELECT a, b, b_n FROM shorter
                                       UNION ALL SELECT b, a, a_n FROM shorter)),
best AS (SELECT a, count(*) AS n_near, min({{'m': -n, 'b': b}}) AS f FROM near GROUP BY a),
named AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
                 CASE WHEN -f.m >= {spelling.FORM_RATIO} * n THEN f.b END AS form,
                 CASE WHEN -f.m >= {spelling.FORM_RATIO} * n THEN (-f.m)::BIGINT END AS form_n
          FROM words LEFT JOIN best ON best.a = words.word),
chain AS (SELECT word, word AS at FROM named UNION ALL
          SELECT chain.word, named.form FROM chain JOIN named ON named.word = chain.at WHERE named.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN named ON named.word = chain.at WHERE named.form IS NULL)
SELECT named.word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)"""


def conversations_sql() -> str:
    """Dynamic programming over (rows done, state): cheapest cost, then the ASCII-least initials."""
    c = conversation
    nxt = ", ".join(f"({s}, {to}, '{c.ROLE[s]}')" for s, to in enumerate(c.NEXT))
    fits = ", ".join(f"({s}, '{ch}', {to})" for s in range(4) for ch, to in zip("sua", c.FITS[s]) if to is not None)
    legal = ", ".join(f"'{p}'" for p in ("su", "ua", "au"))
    best = "SELECT conv, i, s, min(v) AS v FROM ({}) GROUP BY conv, i, s"
    add = "{{'cost': v.cost + {cost}, 'audit': v.audit || '{letter}', 'turns': {turns}}}"
    no, one = "v.turns", "list_append(v.turns, {} || ':' || {})"

    def insert(source: str) -> str:
        value = add.format(cost=c.INSERT, letter="I", turns=one.format("nxt.role", "''"))
        return f"SELECT conv, i, nxt.t AS s, {value} AS v FROM {source} JOIN nxt ON nxt.s = {source}.s"

    row = "JOIN codes ON codes.conv = dp.conv AND codes.i = dp.i + 1"
    moves = [
        f"SELECT dp.conv, dp.i + 1 AS i, dp.s, {add.format(cost=c.DELETE, letter='D', turns=no)} AS v FROM dp {row}",
        f"SELECT dp.conv, dp.i + 1 AS i, fits.t AS s, "
        f"{add.format(cost='cut', letter='K', turns=one.format('codes.role', 'codes.text'))} AS v "
        f"FROM dp {row} JOIN fits ON fits.s = dp.s AND fits.ch = codes.ch WHERE NOT must_go",
        f"SELECT dp.conv, dp.i + 1 AS i, nxt.t AS s, "
        f"{add.format(cost=f'{c.REROLE} + cut', letter='R', turns=one.format('nxt.role', 'codes.text'))} AS v "
        f"FROM dp {row} JOIN nxt ON nxt.s = dp.s WHERE NOT must_go"]
    start = (f"SELECT conv, 0 AS i, {c._START} AS s, "
             "{'cost': 0, 'audit': '', 'turns': []::VARCHAR[]} AS v FROM (SELECT DISTINCT conv FROM codes) t")

    def closed(source: str) -> str:
        """With no, one or two inserts: more never pay at one place."""
        return best.format(f"SELECT * FROM {source} UNION ALL {insert(source)} UNION ALL "
                           f"SELECT * FROM (WITH once AS ({insert(source)}) {insert('once')})")

    return f"""
WITH RECURSIVE {CRC_TABLE},
nxt(s, t, role) AS (VALUES {nxt}), fits(s, ch, t) AS (VALUES {fits}),
src AS (SELECT coalesce('=' || conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
        FROM conversations, tab),
hurt AS (SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
         FROM src WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
placed AS (SELECT *, i > min(i) OVER (PARTITION BY conv, role, text) AS again,
                  rtrim(text, {SPACES}) AS ended, substr(role, 1, 1) AS ch FROM numbered),
codes AS (SELECT conv, i, turn, role, text, ch, ended = '' AS blank, ended <> '' AND again AS repeated,
                 ended = '' OR again AS must_go,
                 (ended <> '' AND NOT again AND substr(ended, length(ended)) NOT IN ('.', '!', '?'))::INTEGER AS cut,
                 lag(ch) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate, sum(cut) AS truncated,
                  count(*) FILTER (i > 1 AND before || ch NOT IN ({legal})) AS illegal, count(*) AS n
           FROM codes GROUP BY conv),
began AS ({start}),
dp AS (({closed('began')}) UNION ALL (WITH moved AS ({best.format(' UNION ALL '.join(moves))}) {closed('moved')})),
ends AS (SELECT dp.conv, min(v) AS v FROM dp JOIN counts ON counts.conv = dp.conv AND counts.n = dp.i
         WHERE dp.s IN ({c._START}, {c._ASSISTANT}) GROUP BY dp.conv)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit,
       sha256(coalesce(array_to_string(v.turns, chr(10)), '')) AS repaired_sha256
FROM conversations LEFT JOIN counts ON counts.conv = coalesce('=' || conv_id::VARCHAR, '')
LEFT JOIN ends ON ends.conv = coalesce('=' || conv_id::VARCHAR, '')"""


def line_rules_sql() -> str:
    norm = (f"translate(translate(array_to_string(regexp_extract_all(line, {WORDS}), ' '), "
            f"'{licenses.UPPER}', '{licenses.UPPER.lower()}'), '123456789', '000000000')")
    w = line_rules.WINDOW_WORDS
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
lines AS (SELECT doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line FROM d),
real AS (SELECT doc_id, source, whole, line, len(regexp_extract_all(line, {WORDS})) AS n,
                md5({norm}) AS k
         FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id),
keys AS (SELECT doc_id, source, k, sum(n) AS n FROM real GROUP BY doc_id, source, k),
often AS (SELECT source, k FROM real GROUP BY source, k HAVING count(DISTINCT whole) > {line_rules.LINE_MIN_DOCS}),
gone AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM keys
         WHERE EXISTS (SELECT 1 FROM often WHERE often.k = keys.k AND often.source IS NOT DISTINCT FROM keys.source)
         GROUP BY doc_id),
starts AS (SELECT doc_id, unnest(range(1, len(words) - {w - 2})) AS i FROM d WHERE len(words) >= {w}),
wins AS (SELECT starts.doc_id, i, array_to_string(words[i:i + {w - 1}], ' ') AS win FROM starts JOIN d USING (doc_id)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(i, i + {w})) AS p FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < {line_rules.MIN_WORDS}
                OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (n_words - removed_words) < {line_rules.MIN_LEFT_PERCENT} * n_words AS kept,
       removed_words
FROM b"""


def warc_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM first_id
            THEN first_id END AS refers_to
FROM f"""


def licenses_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in licenses.known_sentences().items())
    low = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}')"
    for old, new in licenses.PLAIN:
        low = f"replace({low}, {quoted(old).replace(chr(13), chr(39) + ' || chr(13) || ' + chr(39))}, {quoted(new)})"
    low = f"regexp_replace({low}, {quoted(licenses.COMMENT)}, '', 'g')"
    norm = f"trim(regexp_replace(sentence, '{licenses.NOT_WORD}', ' ', 'g'))"
    for pattern, name in licenses.WILDCARDS:
        norm = f"regexp_replace({norm}, {quoted(pattern)}, {quoted(name)})"
    companions = ", ".join(quoted(c) for c in sorted(licenses.COMPANIONS))
    steps, prev = [], "seq0"
    for n, (name, ids) in enumerate(licenses.RULES, 1):
        pattern = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{n} AS (SELECT *, replace(rest{n - 1}, '{pattern}', '|') AS rest{n}, "
                     f"(length(rest{n - 1}) - length(replace(rest{n - 1}, '{pattern}', '|'))) // {len(pattern) - 1} AS c{n} "
                     f"FROM {prev})")
        prev = f"r{n}"
    n = len(licenses.RULES)
    found = " || ".join(f"repeat('{name},', c{i}::BIGINT)" for i, (name, _) in enumerate(licenses.RULES, 1))
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS place FROM (
    SELECT doc_id, string_split_regex({low}, {quoted(licenses.SENTENCE_END)}) AS p FROM documents)),
whole AS (SELECT doc_id, place, 0 AS line, id FROM (SELECT doc_id, place, {norm} AS n FROM s) JOIN known ON known.sentence = n),
parts AS (SELECT doc_id, place, unnest(l) AS sentence, unnest(range(len(l))) AS line
          FROM (SELECT doc_id, place, string_split(sentence, chr(10)) AS l FROM s ANTI JOIN whole USING (doc_id, place))),
ids AS (SELECT * FROM whole UNION ALL
        SELECT doc_id, place, line, id FROM (SELECT doc_id, place, line, {norm} AS n FROM parts) JOIN known ON known.sentence = n),
seq AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY place, line) AS sentence_ids,
               coalesce(string_agg('<' || id || '>', '' ORDER BY place, line) FILTER (id NOT IN ({companions})), '') AS rest0
        FROM ids GROUP BY doc_id),
seq0 AS (SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
                coalesce(rest0, '') AS rest0 FROM documents LEFT JOIN seq USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, rtrim({found}, ',') AS licenses,
       ({" + ".join(f"c{i}" for i in range(1, n + 1))})::BIGINT AS n_licenses,
       length(regexp_replace(rest{n}, '[^<]', '', 'g'))::BIGINT AS n_unmatched
FROM r{n}"""


def sharding_sql(shards: int = SHARDS) -> str:
    def draw(i: int) -> str:
        return f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{i}'), 1, {sharding.HASH_DIGITS}))::BIGINT"

    def best(n: int) -> str:
        # list_position gives the first of equal draws: ties go to the smaller shard
        draws = "[" + ", ".join(draw(i) for i in range(n)) + "]"
        return f"(list_position({draws}, list_max({draws})) - 1)::INTEGER"

    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
             {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM documents),
c AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
                                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32
      FROM d, tab)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM c"""


ORACLE: dict[str, str] = {
    "op3_line_rules": line_rules_sql(),
    "op4_warc": warc_sql(),
    "op7_licenses": licenses_sql(),
    "op10_sharding": sharding_sql(),
    "op11_line_dedup": line_dedup_sql(),
    "op12_spelling": spelling_sql(),
    "op13_conversations": conversations_sql(),
}
