"""SQL (DuckDB dialect) that states what each registered query must return."""

from __future__ import annotations

from convspark.config import CRITERIA
from convspark.functions.replies import ASSISTANT_MARKERS
from convspark.functions.text import STOP_WORDS
from workload import samples as sm

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"

MESSAGES = """
lines AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM conversations),
m AS (
  SELECT conv_id % 4 AS chat_id, conv_id*10000 + turn*100 + i AS message_id,
    CAST(1704067200 + conv_id*86400 + turn*1500
      + CASE WHEN conv_id%5=0 AND turn>=4 THEN 10800 ELSE 0 END
      + (i-1) * CASE WHEN (conv_id+turn)%3=0 THEN 200 ELSE 40 END AS BIGINT) AS ts,
    CASE role WHEN 'assistant' THEN 1001 WHEN 'system' THEN conv_id % 4 + 2002 ELSE conv_id % 4 + 1002 END AS sender_id,
    CASE role WHEN 'assistant' THEN 'me' WHEN 'system' THEN 's' || (conv_id % 4) ELSE 'p' || (conv_id % 4) END AS sender_name,
    role = 'assistant' AS is_me, line AS text,
    (conv_id*7 + turn*3 + i) % 11 = 0 AS is_forwarded
  FROM lines WHERE trim(line) <> '')"""

TURNS = MESSAGES + """,
m1 AS (
  SELECT *, CASE WHEN lag(sender_id) OVER w IS NULL OR lag(sender_id) OVER w <> sender_id
                   OR ts - lag(ts) OVER w > 180 THEN 1 ELSE 0 END AS opens
  FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY ts, message_id)),
m2 AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY chat_id ORDER BY ts, message_id) - 1 AS BIGINT) AS turn_idx FROM m1),
turns AS (
  SELECT chat_id, turn_idx, arg_min(sender_id, (ts, message_id)) AS sender_id, bool_or(is_me) AS is_me,
    arg_min(sender_name, (ts, message_id)) AS sender_name,
    min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_messages,
    arg_min(message_id, (ts, message_id)) AS first_id,
    string_agg(text, chr(10) ORDER BY ts, message_id) AS text,
    coalesce(string_agg(text, chr(10) ORDER BY ts, message_id) FILTER (WHERE NOT is_forwarded), '') AS own_text,
    bool_or(is_forwarded) AS has_forwarded
  FROM m2 GROUP BY chat_id, turn_idx)"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LINKS = r"(?i)(https?://|www\.|t\.me/)\S+|<(url|phone|email|card)>"


def reply_reason(x: str) -> str:
    s = strip(x)
    bare = f"regexp_replace({s}, '{LINKS}', '', 'g')"
    return f"""CASE WHEN length({s}) < 3 THEN 'reply_too_short'
      WHEN {bare} <> {s} AND NOT regexp_matches({bare}, '{W}') THEN 'reply_bare_link'
      WHEN NOT regexp_matches({s}, '{W}') THEN 'reply_no_words'
      WHEN length({s}) > 2000 THEN 'reply_too_long' END"""


OWN = TURNS + f""",
cv AS (
  SELECT *, CASE WHEN start_ts - lag(end_ts) OVER w > 7200 THEN 1 ELSE 0 END AS brk
  FROM turns WINDOW w AS (PARTITION BY chat_id ORDER BY turn_idx)),
cx AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY chat_id ORDER BY turn_idx) AS BIGINT) AS conv,
    coalesce(list({{'end_ts': end_ts, 'is_me': is_me, 'sender_name': sender_name, 'text': text}}) OVER (
      PARTITION BY chat_id ORDER BY turn_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS before
  FROM cv),
own AS (
  SELECT chat_id || ':' || first_id AS pair_id, chat_id, chat_id || ':' || conv AS conversation_id, start_ts AS ts,
    strftime(make_timestamp(start_ts*1000000), '%Y-%m') AS period,
    list_filter(before, lambda t: start_ts - t.end_ts <= 7200) AS context, own_text AS reply, n_messages, has_forwarded
  FROM cx WHERE is_me),
judged AS (
  SELECT *, CASE WHEN {strip('reply')} = '' AND has_forwarded THEN 'reply_forwarded_only'
    WHEN len(context) = 0 THEN 'no_context'
    WHEN context[len(context)].is_me THEN 'no_partner_context'
    ELSE {reply_reason('reply')} END AS drop_reason
  FROM own),
pairs AS (SELECT * FROM judged WHERE drop_reason IS NULL)"""

SPLIT = OWN + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, pair_id) AS rn, count(*) OVER (PARTITION BY chat_id) AS n
  FROM pairs),
cuts AS (
  SELECT chat_id, max(n) AS n, CASE WHEN max(n) >= 20
     THEN max(ts) FILTER (WHERE rn = n - greatest(1, CAST(floor(n*0.15 + 0.5) AS BIGINT)) + 1) END AS cutoff
  FROM ranked GROUP BY chat_id),
divided AS (
  SELECT p.*, CASE WHEN p.ts >= c.cutoff THEN 'holdout' ELSE 'train' END AS split
  FROM pairs p JOIN cuts c USING (chat_id)),
held AS (SELECT *, chat_id || ':' || period AS stratum, sha256('20260905:' || pair_id) AS draw FROM divided WHERE split='holdout'),
sizes AS (SELECT stratum, count(*) AS size FROM held GROUP BY stratum),
tot AS (SELECT coalesce(sum(size),0) AS p, least(80, coalesce(sum(size),0)) AS t FROM sizes),
alloc0 AS (SELECT stratum, size, size*t // p AS base, (size*t) % p AS rest, t FROM sizes, tot),
alloc AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS allocation FROM alloc0),
chosen AS (
  SELECT pair_id FROM (SELECT pair_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY draw, pair_id) AS pos FROM held)
  JOIN alloc USING (stratum) WHERE pos <= allocation),
split_pairs AS (SELECT d.*, d.pair_id IN (SELECT pair_id FROM chosen) AS eval_sample FROM divided d),
train AS (SELECT * FROM split_pairs WHERE split = 'train')"""


def speaker_line(t: str = "t", name: str = "Me") -> str:
    return f"(CASE WHEN {t}.is_me THEN '{name}' ELSE 'Собеседник' END) || ': ' || {t}.text"


def transcript(array: str) -> str:
    return f"coalesce(array_to_string(list_transform({array}, lambda t: {speaker_line()}), chr(10)), '')"


def pct(condition: str, whole: str = "count(*)") -> str:
    c, t = f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)", f"CAST({whole} AS BIGINT)"
    return f"CASE WHEN {t} > 0 THEN ((2000*{c} + {t}) // (2*{t})) / 10.0 ELSE 0.0 END"


def quantile(value: str, q: float) -> str:
    """Value at the half-even rounded position of the sorted list."""
    values = f"list({value} ORDER BY {value})"
    return f"CAST(coalesce({values}[CAST(round_even({q}*(count({value})-1), 0) AS BIGINT)+1], 0) AS BIGINT)"


def mean3(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN (({total})*2000 + {n}) // ({n}*2) / 1000.0 END"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(kind: list[str], every: int, gap: str = "' '") -> str:
    return f"SELECT doc_id, {sm.pick_sql(kind, 'doc_id', every, quote(''))} || {gap} || text AS text FROM documents"


TOKENS = "regexp_extract_all(lower({x}), '[а-яёa-z]{{2,}}')"

RAW = MESSAGES + f""",
raw AS (
  SELECT chat_id, CASE WHEN chat_id = 3 THEN 'private_group' ELSE 'personal_chat' END AS chat_type, message_id AS pos,
    CASE WHEN message_id%29=0 THEN 'x'||message_id ELSE CAST(message_id AS VARCHAR) END AS raw_id,
    CASE WHEN message_id%17=0 THEN 'service' WHEN message_id%31=0 THEN 'other' ELSE 'message' END AS type,
    CASE WHEN message_id%17=0 THEN CASE WHEN message_id%2=0 THEN 'phone_call' ELSE 'pin_message' END END AS action,
    CASE WHEN message_id%19=0 THEN 'sticker' WHEN message_id%23=0 THEN 'voice_message'
         WHEN message_id%13=0 THEN 'photo' END AS media,
    CASE WHEN message_id%14=0 THEN 'poll' END AS payload,
    CASE WHEN (message_id%11=0 OR message_id%13=0 OR message_id%14=0 OR message_id%23=0) AND message_id%3<>0 THEN '  ' ELSE text END AS text,
    CASE WHEN message_id%37=0 THEN 'bogus' WHEN is_me THEN 'user1001' ELSE 'user'||sender_id END AS from_id,
    CASE WHEN message_id%7=0 THEN NULL ELSE ts END AS unix,
    CASE WHEN message_id%49=0 THEN NULL ELSE ts+10800 END AS local,
    CASE WHEN message_id%5=0 THEN message_id-1 WHEN message_id%41=0 THEN message_id+50 END AS reply_to, is_forwarded
  FROM m),
cls AS (
  SELECT *, CASE WHEN message_id_ok IS NULL THEN NULL ELSE message_id_ok END AS record_id, coalesce(unix, local) AS stamp,
    CASE WHEN message_id_ok IS NULL THEN 'malformed' WHEN type='service' THEN 'service' WHEN type<>'message' THEN 'unsupported_type'
      WHEN media='sticker' THEN 'sticker' WHEN trim(text)='' AND media IS NOT NULL THEN 'media_without_caption'
      WHEN trim(text)='' AND payload IS NOT NULL THEN 'non_text_payload' WHEN trim(text)='' THEN 'empty_text'
      WHEN from_id='bogus' THEN 'unknown_sender' WHEN coalesce(unix, local) IS NULL THEN 'bad_timestamp' END AS reason,
    CASE WHEN message_id_ok IS NULL THEN 'bad_id' WHEN type='service' THEN action WHEN type<>'message' THEN type
      WHEN media='sticker' THEN 'sticker' WHEN trim(text)='' AND media IS NOT NULL THEN media
      WHEN trim(text)='' AND payload IS NOT NULL THEN payload WHEN trim(text)='' THEN NULL
      WHEN from_id='bogus' OR coalesce(unix, local) IS NULL THEN NULL ELSE coalesce(media, payload) END AS kind
  FROM (SELECT *, TRY_CAST(raw_id AS BIGINT) AS message_id_ok FROM raw))"""

LIVE = """
live AS (
  SELECT user_id % 5 AS chat_id, event_id AS message_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id,
    CASE event_type WHEN 'purchase' THEN 'owner' WHEN 'error' THEN 'bot' ELSE 'partner' END AS origin,
    CASE WHEN value > 60 AND event_type NOT IN ('purchase','error') THEN 'bulk' END AS kind,
    CASE WHEN event_id % 23 = 0 THEN '' ELSE 'msg ' || event_id || CASE WHEN event_id % 4 = 0 THEN '?' ELSE '' END END AS text
  FROM events)"""

MEMORY = LIVE + """,
turns AS (
  SELECT chat_id, message_id, ts, origin <> 'partner' AS is_me, origin = 'bot' AS by_bot, kind IS NOT NULL AS flagged,
    length(text) + 251 AS chars FROM live)"""


def fraction(text: str) -> str:
    return f"(CAST('0x' || substr(sha256({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


RECORDS = """
rec AS (
  SELECT 'run' || run AS run_id, '1:' || doc_id AS pair_id, '2024-0' || (doc_id % 6 + 1) AS period,
    CASE WHEN (doc_id + run) % 17 <> 0 THEN text END AS output, CASE WHEN (doc_id + run) % 19 = 0 THEN 'boom' END AS error,
    CASE WHEN (doc_id * run) % 11 = 0 THEN 'hybrid' END AS fallback_from, n_chars % 2000 AS latency_ms, doc_id, run, lang,
    CASE WHEN doc_id % 37 = 0 THEN 'no_json'
         WHEN doc_id % 13 = 0 OR doc_id % 31 = 0 THEN 'bad_score:consistency' END AS judge_error,
    (doc_id*7 + run*3 + 5) % 5 + 1 AS s1, (doc_id*7 + run*3 + 10) % 5 + 1 AS s2,
    (doc_id*7 + run*3 + 15) % 5 + 1 AS s3, (doc_id*7 + run*3 + 20) % 5 + 1 AS s4
  FROM documents, (VALUES (1), (2), (3)) r(run))"""

SUMMARY_COLUMNS = ", ".join(
    f"coalesce({mean3(f'CAST(sum(s{i}) FILTER (WHERE judge_error IS NULL) AS BIGINT)', 'count(*) FILTER (WHERE judge_error IS NULL)')}, 0.0) AS {c}"
    for i, c in enumerate(CRITERIA, 1)
)


def summary(source: str = "rec") -> str:
    total = " + ".join(f"CAST(round({c}*1000) AS BIGINT)" for c in CRITERIA)
    return f"""
base AS (
  SELECT run_id, count(*) AS n, count(*) FILTER (WHERE judge_error IS NULL) AS judged,
    count(*) FILTER (WHERE output IS NULL) AS silent, count(*) FILTER (WHERE fallback_from IS NOT NULL) AS fallbacks,
    count(*) FILTER (WHERE error IS NOT NULL OR judge_error IS NOT NULL) AS errors, {SUMMARY_COLUMNS},
    {quantile('latency_ms', 0.5)} AS latency_ms_p50
  FROM {source} GROUP BY run_id),
summary AS (SELECT *, {mean3(total, '4000')} AS overall FROM base)"""


RUNS = """
runs AS (
  SELECT 'run' || run AS run_id, '2024-05-0' || (4 - run) || 'T00:00:00Z' AS started_at,
    CASE WHEN run = 2 THEN 'rag' ELSE 'hybrid' END AS mode, 'model' || (run % 2) AS model,
    CASE WHEN run = 3 THEN 'v2' ELSE 'v1' END AS prompt_version, CASE WHEN run = 3 THEN 'j2' ELSE 'j1' END AS judge_prompt,
    CASE WHEN run <> 1 THEN 'p' || run END AS profile
  FROM (VALUES (1), (2), (3)) r(run))"""

VOTES = """
votes AS (
  SELECT '1:' || doc_id AS pair_id, {a} AS va, {b} AS vb FROM (SELECT doc_id, length(coalesce(text, '')) AS k FROM documents))"""


def vote(shift: int) -> str:
    """Winner, or ``bad`` for an answer that cannot be used."""
    return f"""CASE WHEN (k+{shift}) % 13 = 0 THEN 'bad' WHEN (k+{shift}) % 5 = 0 THEN 'tie'
      WHEN (k+{shift}) % 7 = 0 THEN '1' WHEN (k+{shift}) % 11 = 0 THEN 'bad'
      WHEN (k*{shift}) % 3 = 0 THEN '2' ELSE '1' END"""


DUELS = VOTES.format(a=vote(1), b=vote(2)) + """,
duels AS (
  SELECT pair_id, nullif(va, 'bad') AS a_first_winner, nullif(vb, 'bad') AS b_first_winner, va = 'bad' OR vb = 'bad' AS has_error,
    CASE WHEN va = '1' AND vb = '2' THEN 'a' WHEN va = '2' AND vb = '1' THEN 'b' ELSE 'tie' END AS outcome FROM votes)"""

VECTORS = """
vec AS (
  SELECT vec_id AS pair_id, vec_id % 4 AS chat_id, vec_id AS ts, vec_id % 50 AS reply_key, label,
    CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cand AS (
  SELECT q.pair_id AS query_id, v.pair_id, v.ts, v.reply_key, q.chat_id AS q_chat, v.chat_id AS v_chat, v.label,
    round(1.0 - list_cosine_similarity(q.e, v.e), 6) AS distance
  FROM vec q, vec v)"""


def neighbours(name: str, where: str, k: int, overfetch: int = 4) -> str:
    return f"""
{name}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pair_id) AS hit FROM cand WHERE {where}),
{name}_kept AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, reply_key ORDER BY hit) AS copy_no FROM {name}_hits WHERE hit <= {k * overfetch}),
{name} AS (
  SELECT * FROM (SELECT query_id, pair_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY hit) AS rank
                 FROM {name}_kept WHERE copy_no = 1) WHERE rank <= {k})"""


def rolled(limit_hour: int, limit_day: int) -> str:
    """Codes of the rows that pass a budget in which only passes count, one list per chat."""
    return f"""list_reduce(
      list(CAST([ts*10000000 + message_id] AS BIGINT[]) ORDER BY ts, message_id),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: c // 10000000 > x[1] // 10000000 - 3600)) < {limit_hour}
                           AND len(list_filter(acc, lambda c: c // 10000000 > x[1] // 10000000 - 86400)) < {limit_day}
                     THEN list_concat(acc, x) ELSE acc END, CAST([] AS BIGINT[]))"""


PHONE = (
    r"(^|[^\p{L}\p{N}_+])(?:\+\d{1,3}[\s\-(]*\d{3}|[78][\s\-(]*\d{3}|9\d{2})"
    r"[\s\-)]*\d{3}[\s-]*\d{2}[\s-]*\d{2}($|[^\p{L}\p{N}_-])"
)
CARD = r"(^|[^\d])(?:\d{4}[ -]?){3}\d{4}(?:[ -]?\d{1,3})?\b"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
MENTION = r"(^|[^\p{L}\p{N}_@])@[A-Za-z][A-Za-z0-9_]{3,31}\b"
TOKEN_URL = (
    r"(?i)(?:https?://|www\.)[^\s<>\"']*[?&#](?:token|access_token|auth|key|api_key|apikey|sig|signature|secret|"
    r"session|password|pwd|code|invite|hash)=[^\s<>\"']*|(?:https?://)?t\.me/(?:\+|joinchat/)[^\s<>\"']*|"
    r"(?:https?://)?\bt\.me/[A-Za-z][A-Za-z0-9_]{3,31}/?\b"
).replace("'", "''")


def cleaned() -> str:
    """Two passes for phones: a match takes the character behind it, so the next of two neighbours is found later."""
    return f"""
src AS ({documents(sm.CONTACTS, 20)}),
c1 AS (SELECT *, regexp_replace(text, '{TOKEN_URL}', '<url>', 'g') AS t1 FROM src),
c2 AS (SELECT *, regexp_replace(t1, '{EMAIL}', '<email>', 'g') AS t2 FROM c1),
c3 AS (SELECT *, regexp_replace(t2, '{MENTION}', '\\1@user', 'g') AS t3 FROM c2),
c4 AS (SELECT *, regexp_replace(t3, '{CARD}', '\\1<card>', 'g') AS t4 FROM c3),
c4b AS (SELECT *, regexp_replace(t4, '{PHONE}', '\\1<phone>\\2', 'g') AS t4b FROM c4),
c5 AS (SELECT *, regexp_replace(t4b, '{PHONE}', '\\1<phone>\\2', 'g') AS t5 FROM c4b)"""


def count_of(pattern: str, x: str) -> str:
    return f"CAST(sum(len(regexp_extract_all({x}, '{pattern}'))) AS BIGINT)"


def style(condition_text: str = "reply") -> str:
    return condition_text


ORACLE: dict[str, str] = {}


def add(name: str, select: str, *ctes: str) -> None:
    ORACLE[name] = ("WITH " + ",\n".join(c.strip() for c in ctes) + "\n" if ctes else "") + select


add("build_turns", """SELECT chat_id, turn_idx, sender_id, is_me, start_ts, end_ts, n_messages, first_id, text, own_text,
  has_forwarded FROM turns""", TURNS)
add("conversations", """SELECT chat_id, count(*) AS turns, max(conv) + 1 AS conversations FROM cx GROUP BY chat_id""", OWN)
add("build_pairs", f"""SELECT pair_id, chat_id, conversation_id, ts, period, len(context) AS n_context,
  {transcript('context')} AS context_text, reply, n_messages FROM pairs""", OWN)
add("pair_drops", "SELECT drop_reason AS reason, count(*) AS turns FROM judged WHERE drop_reason IS NOT NULL GROUP BY 1", OWN)
add("pairs_by_period", """SELECT chat_id, period, count(*) AS pairs, CAST(sum(length(reply)) AS BIGINT) AS reply_chars,
  max(len(context)) AS max_context FROM pairs GROUP BY chat_id, period""", OWN)
THEIRS = "list_filter(context, lambda t: NOT t.is_me)"
add("index_text", f"""SELECT pair_id, array_to_string(list_transform(
    CASE WHEN len({THEIRS}) > 0 THEN {THEIRS}[-2:] ELSE context[-2:] END, lambda t: t.text), chr(10)) AS document FROM pairs""", OWN)
add("split_pair", f"""SELECT pair_id, {transcript('context[:-2]')} AS history, context[-1].text AS incoming,
  list_filter(context[:-2], lambda t: NOT t.is_me)[-1].text AS previous, {THEIRS}[-1].text AS last_partner_text FROM pairs""", OWN)
add("informative_pairs", f"SELECT pair_id, ts, length(reply) AS chars FROM train WHERE length({strip('reply')}) >= 20", SPLIT)
PARTS = "len(list_filter(string_split({x}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> ''))"
add("reply_length_profile", f"""SELECT period, count(*) AS replies, {pct('length(reply) > 100')} AS over_100_pct,
  round(CAST(sum(least({PARTS.format(x='reply')}, 5)) AS DOUBLE) / count(*), 2) AS parts_per_reply,
  {quantile('length(reply)', 0.5)} AS chars_p50, {quantile('length(reply)', 0.75)} AS chars_p75,
  {quantile('length(reply)', 0.9)} AS chars_p90, max(length(reply)) AS chars_max FROM pairs GROUP BY period""", OWN)
add("render_context", f"SELECT pair_id, {transcript('context')} AS transcript FROM pairs", OWN)

add("nearest_rank_quantiles_by_chat", f"""SELECT chat_id, count(*) AS n, {quantile('length(text)', 0.5)} AS p50,
  {quantile('length(text)', 0.9)} AS p90, {quantile('length(text)', 0.99)} AS p99, max(length(text)) AS max,
  CAST(sum(length(text)) AS BIGINT) AS total FROM m GROUP BY chat_id""", MESSAGES)
EXPORT = MESSAGES + """,
x AS (SELECT *, message_id - CASE WHEN message_id%53=0 THEN 400 ELSE 0 END + CASE WHEN message_id%53=0 THEN 0.5 ELSE 0 END AS pos FROM m),
g AS (SELECT ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY pos) AS gap FROM x)"""
add("message_stats", f"""SELECT count(*) AS rows, count(*) FILTER (WHERE length(text)=0) AS empty_text_rows,
  count(*) FILTER (WHERE length(text)>2000) AS long_text_rows, count(*) FILTER (WHERE sender_name IS NULL) AS sender_name_null_rows,
  count(*) FILTER (WHERE message_id%5=0) AS reply_rows, count(*) FILTER (WHERE is_forwarded) AS forwarded_rows,
  count(*) FILTER (WHERE message_id%43=0) AS caption_rows, count(*) FILTER (WHERE message_id%47=0) AS edited_rows,
  count(*) FILTER (WHERE is_me) AS me_rows, strftime(make_timestamp(min(ts)*1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_min,
  strftime(make_timestamp(max(ts)*1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_max,
  count(*) - count(DISTINCT (chat_id, message_id)) AS duplicate_keys, {quantile('length(text)', 0.5)} AS text_chars_p50,
  {quantile('length(text)', 0.9)} AS text_chars_p90, {quantile('length(text)', 0.99)} AS text_chars_p99,
  max(length(text)) AS text_chars_max, (SELECT count(*) FROM g WHERE gap < 0) AS out_of_order_rows,
  (SELECT count(*) FROM g WHERE gap > 2592000) AS gaps_over_30d,
  (SELECT round(greatest(coalesce(max(gap),0),0)/86400.0, 1) FROM g) AS max_gap_days FROM x""", EXPORT)
add("rows_per_year", "SELECT strftime(make_timestamp(ts*1000000), '%Y') AS year, count(*) AS rows FROM m GROUP BY 1", MESSAGES)


def stats_select(source: str, limit: int) -> str:
    chars = "CAST(coalesce(list_sum(list_transform(context, lambda t: length(t.text))), 0) AS BIGINT)"
    gaps = f"(SELECT ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, pair_id) AS gap FROM {source})"
    return f"""SELECT count(*) AS rows, count(*) FILTER (WHERE length(reply)=0) AS empty_replies,
  count(*) FILTER (WHERE length(reply)>{limit}) AS replies_over_max, {pct('length(reply)<=10')} AS replies_le_10_chars_pct,
  {pct(f"regexp_matches(reply, '{EMOJI}')")} AS replies_with_emoji_pct, {pct("contains(reply,'?')")} AS replies_with_question_pct,
  {pct("contains(reply,chr(10))")} AS replies_multiline_pct,
  count(*) FILTER (WHERE len(list_filter(context, lambda t: t.sender_name IS NULL))>0) AS context_sender_name_null_rows,
  count(*) - count(DISTINCT pair_id) AS duplicate_pair_ids, count(*) - count(DISTINCT reply) AS duplicate_reply_rows,
  count(DISTINCT reply) AS distinct_replies, {quantile('length(reply)',0.5)} AS reply_chars_p50,
  {quantile('length(reply)',0.9)} AS reply_chars_p90, {quantile('length(reply)',0.99)} AS reply_chars_p99,
  coalesce(max(length(reply)),0) AS reply_chars_max, {quantile('len(context)',0.5)} AS context_turns_p50,
  {quantile('len(context)',0.9)} AS context_turns_p90, coalesce(max(len(context)),0) AS context_turns_max,
  {quantile(chars,0.5)} AS context_chars_p50, {quantile(chars,0.9)} AS context_chars_p90,
  (SELECT count(*) FROM {gaps} WHERE gap > 2592000) AS gaps_over_30d,
  (SELECT round(coalesce(max(gap),0)/86400.0, 1) FROM {gaps}) AS max_gap_days FROM {source}"""


add("pair_stats", stats_select("pairs", 2000), OWN)
add("style_by_year", f"""SELECT substr(period,1,4) AS year, count(*) AS pairs, {pct('length(reply)<=10')} AS le_10_chars_pct,
  {pct(f"regexp_matches(reply, '{EMOJI}')")} AS emoji_pct, {pct("contains(reply,'?')")} AS question_pct,
  {pct("contains(reply,chr(10))")} AS multiline_pct, {quantile('length(reply)',0.5)} AS reply_chars_p50,
  {quantile('length(reply)',0.9)} AS reply_chars_p90, {quantile('len(context)',0.5)} AS context_turns_p50
  FROM pairs GROUP BY 1""", OWN)
STARTED = f"{strip('r')} <> ''"
add("reply_style_stats", f"""SELECT count(*) AS replies, {pct('length(r)<=10')} AS le_10_chars_pct,
  {pct("contains(r,chr(10))")} AS multiline_pct, {pct(f"regexp_matches(r, '{EMOJI}')")} AS emoji_pct, {pct("contains(r,'?')")} AS question_pct,
  {pct("contains(r,'!')")} AS exclamation_pct, {pct("contains(r,'...') OR contains(r,'…')")} AS ellipsis_pct,
  {pct(f"ends_with({strip('r')},'.')")} AS ends_with_period_pct, {pct("contains(r,')') AND NOT contains(r,'(')")} AS bracket_smile_pct,
  {pct("contains(r,',')")} AS comma_pct,
  {pct(f"{STARTED} AND regexp_matches({strip('r')}, '^\\p{{Lu}}')", f'count(*) FILTER (WHERE {STARTED})')} AS starts_uppercase_pct,
  {pct(f"regexp_matches(r, '(^|{NW})[А-ЯЁA-Z]{{3,}}($|{NW})')")} AS all_caps_word_pct,
  {pct("regexp_matches(r, '[a-zA-Z]{3,}')")} AS latin_letters_pct, {pct("regexp_matches(r, '[0-9]')")} AS digits_pct,
  {quantile('length(r)',0.5)} AS chars_p50, {quantile('length(r)',0.9)} AS chars_p90,
  {quantile(f"len({TOKENS.format(x='r')})",0.5)} AS words_p50, {quantile("len(string_split(r, chr(10)))",0.9)} AS lines_p90
  FROM (SELECT {sm.pick_sql(sm.REPLIES + sm.EMOJI, 'ts', 100, 'reply')} AS r FROM train)""", SPLIT)
STOP = ", ".join(quote(w) for w in STOP_WORDS)
add("top_words", f"""SELECT word, count(*) AS uses FROM (
  SELECT ts, pair_id, unnest({TOKENS.format(x='reply')}) AS word, generate_subscripts({TOKENS.format(x='reply')}, 1) AS place FROM train)
  WHERE word NOT IN ({STOP}) GROUP BY word ORDER BY uses DESC, min((ts, pair_id, place)) LIMIT 50""", SPLIT)
add("top_emoji", f"""SELECT emoji, count(*) AS uses FROM (
  SELECT ts, pair_id, unnest(regexp_extract_all(r, '{EMOJI}')) AS emoji, generate_subscripts(regexp_extract_all(r, '{EMOJI}'), 1) AS place
  FROM (SELECT ts, pair_id, {sm.pick_sql(sm.EMOJI, '(ts // 100)', 5, quote(''))} || reply AS r FROM train))
  GROUP BY emoji ORDER BY uses DESC, min((ts, pair_id, place)) LIMIT 10""", SPLIT)

SUMMARY = """
chat_rows AS (
  SELECT s.chat_id, row_number() OVER (ORDER BY min(s.ts), s.chat_id) AS chat_index, count(*) AS pairs,
    count(*) FILTER (WHERE split='train') AS train, count(*) FILTER (WHERE split='holdout') AS holdout,
    count(*) FILTER (WHERE eval_sample) AS eval_sample,
    substr(strftime(make_timestamp(max(c.cutoff)*1000000), '%Y-%m-%d'), 1, 10) AS cutoff_date, max(c.n) < 20 AS too_short_for_holdout
  FROM split_pairs s JOIN cuts c USING (chat_id) GROUP BY s.chat_id)"""
RULES = []
for _side in ("train", "holdout"):
    for _c, _n in (("duplicate_pair_ids",) * 2, ("empty_replies",) * 2, ("replies_over_max",) * 2, ("gaps_over_30d", "long_gaps"),
                   ("context_sender_name_null_rows", "null_sender_names")):
        RULES.append(f"SELECT '{_n}' AS rule, '{_side}' AS scope, CAST({_c} AS DOUBLE) AS value, 0.0 AS threshold, {_c} > 0 AS breach FROM s_{_side} WHERE rows > 0")
    RULES.append(f"SELECT 'no_rows', '{_side}', CAST(rows AS DOUBLE), 0.0, rows = 0 FROM s_{_side}")
    RULES.append(f"""SELECT 'repeated_replies', '{_side}', v, 10.0, v > 10 FROM
      (SELECT ((2000*duplicate_reply_rows + rows) // nullif(2*rows, 0))/10.0 AS v FROM s_{_side} WHERE rows > 0)""")
    RULES.append(f"""SELECT 'dominant_year', '{_side}', v, 35.0, v > 35 FROM (SELECT ((2000*max(k) + CAST(sum(k) AS BIGINT)) // (2*CAST(sum(k) AS BIGINT)))/10.0 AS v FROM
      (SELECT count(*) AS k FROM split_pairs WHERE split='{_side}' GROUP BY substr(period,1,4)))""")
for _c, _n in (("replies_with_emoji_pct", "emoji_share_shift"), ("replies_with_question_pct", "question_share_shift"),
               ("replies_le_10_chars_pct", "short_share_shift"), ("replies_multiline_pct", "multiline_share_shift")):
    RULES.append(f"SELECT '{_n}', 'both', v, 5.0, v > 5 FROM (SELECT round(abs(a.{_c} - b.{_c}), 1) AS v FROM s_train a, s_holdout b WHERE a.rows > 0 AND b.rows > 0)")
RULES.append("""SELECT 'median_shift', 'both', round(v, 1), 50.0, v > 50 FROM
  (SELECT abs(b.reply_chars_p50 - a.reply_chars_p50)*100.0/nullif(a.reply_chars_p50, 0) AS v FROM s_train a, s_holdout b WHERE a.rows > 0 AND b.rows > 0)""")
RULES.append("SELECT 'long_replies_dropped', 'all', CAST(count(*) AS DOUBLE), 2000.0, count(*) > 0 FROM judged WHERE drop_reason='reply_too_long'")
RULES.append("SELECT 'short_chat', CAST(chat_index AS VARCHAR), CAST(pairs AS DOUBLE), 20.0, too_short_for_holdout FROM chat_rows")
RULES.append("SELECT 'small_eval_sample', 'holdout', CAST(count(*) AS DOUBLE), 80.0, count(*) < 80 FROM chosen")
RULES.append("""SELECT 'dominant_chat', CAST(arg_max(chat_index, (pairs, -chat_index)) AS VARCHAR),
  ((2000*max(pairs) + CAST(sum(pairs) AS BIGINT)) // (2*CAST(sum(pairs) AS BIGINT)))/10.0, 70.0, count(*) > 1 AND max(pairs)*10 > sum(pairs)*7 FROM chat_rows""")
add("profile_caveats", "SELECT rule, scope, value, CAST(threshold AS DOUBLE) AS threshold FROM (" + "\nUNION ALL ".join(RULES) + ") WHERE breach",
    SPLIT, SUMMARY, "s_train AS (" + stats_select("train", 1500) + ")",
    "held_pairs AS (SELECT * FROM split_pairs WHERE split='holdout')", "s_holdout AS (" + stats_select("held_pairs", 1500) + ")")

add("time_split", "SELECT pair_id, split FROM divided", SPLIT)
add("allocate_proportionally", """SELECT stratum, size, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS allocation
  FROM (SELECT stratum, size, CAST(size*t // p AS BIGINT) AS base, (size*t) % p AS rest, t FROM
    (SELECT chat_id || ':' || period AS stratum, count(*) AS size FROM pairs GROUP BY 1),
    (SELECT CAST(count(*) AS BIGINT) AS p, least(50, count(*)) AS t FROM pairs))""", OWN)
ORACLE["allocate_proportionally"] = ORACLE["allocate_proportionally"].replace("SELECT stratum, size, base +", "SELECT stratum, size, CAST(base +", 1).replace("END AS allocation", "END AS BIGINT) AS allocation", 1)
add("stratified_sample", """SELECT doc_id, lang, n_chars FROM (
    SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS pos FROM documents)
  JOIN (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS allocation
    FROM (SELECT lang, size*t // p AS base, (size*t) % p AS rest, t FROM (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
      (SELECT count(*) AS p, least(60, count(*)) AS t FROM documents))) USING (lang) WHERE pos <= allocation""")
add("eval_sample", "SELECT pair_id, split, eval_sample FROM split_pairs", SPLIT)
add("split_summary", "SELECT chat_index, pairs, train, holdout, eval_sample, cutoff_date, too_short_for_holdout FROM chat_rows", SPLIT, SUMMARY)
add("split_by_year", """SELECT substr(period,1,4) AS year, count(*) FILTER (WHERE split='train') AS train,
  count(*) FILTER (WHERE split='holdout') AS holdout FROM divided GROUP BY 1""", SPLIT)
add("leakage_check", """SELECT pair_id, 'id_in_both' AS violation FROM h WHERE pair_id IN (SELECT pair_id FROM t)
  UNION ALL SELECT pair_id, 'not_later' FROM h JOIN (SELECT chat_id, max(ts) AS latest FROM t GROUP BY 1) USING (chat_id) WHERE ts <= latest""",
    SPLIT, "t AS (SELECT * FROM split_pairs WHERE split = 'train' OR eval_sample), h AS (SELECT * FROM split_pairs WHERE split = 'holdout')")
add("accounting_check", """SELECT "check", left_count, right_count, left_count = right_count AS balanced FROM (
  SELECT 'pairs + dropped = own turns' AS "check", count(drop_reason) + count(*) FILTER (WHERE drop_reason IS NULL) AS left_count, count(*) AS right_count FROM judged
  UNION ALL SELECT 'train + holdout = pairs', count(*), (SELECT count(*) FROM pairs) FROM divided
  UNION ALL SELECT 'eval by period = eval flags', (SELECT CAST(coalesce(sum(k),0) AS BIGINT) FROM (SELECT count(*) AS k FROM split_pairs WHERE eval_sample GROUP BY period)), (SELECT count(*) FROM chosen)
  UNION ALL SELECT 'train by year = train', (SELECT CAST(coalesce(sum(k),0) AS BIGINT) FROM (SELECT count(*) AS k FROM train GROUP BY substr(period,1,4))), (SELECT count(*) FROM train)
  UNION ALL SELECT 'holdout by year = holdout', (SELECT CAST(coalesce(sum(k),0) AS BIGINT) FROM (SELECT count(*) AS k FROM held GROUP BY substr(period,1,4))), (SELECT count(*) FROM held))""", SPLIT)
add("dataset_version", """SELECT count(*) AS rows, substr(sha256(count(*) || ':' || sum(h)), 1, 12) AS dataset_version FROM (
  SELECT CAST(CAST('0x' || substr(sha256(CAST(to_json({'chat_id': chat_id, 'message_id': message_id, 'ts': ts, 'text': text}) AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT) AS h FROM m)""", MESSAGES)
add("sample_identity", """SELECT count(*) AS ids, substr(sha256(count(*) || ':' || coalesce(sum(h), 0)), 1, 12) AS identity FROM (
  SELECT CAST(CAST('0x' || substr(sha256(pair_id), 1, 15) AS BIGINT) AS HUGEINT) AS h FROM chosen)""", SPLIT)

add("anonymize_documents", "SELECT doc_id, t5 AS text FROM c5", cleaned())
add("anonymize_counts", f"""SELECT {count_of(TOKEN_URL, 'text')} AS token_url, {count_of(EMAIL, 't1')} AS email, {count_of(MENTION, 't2')} AS mention,
  {count_of(CARD, 't3')} AS card, {count_of(PHONE, 't4')} + {count_of(PHONE, 't4b')} AS phone FROM c5""", cleaned())
add("term_findings", """SELECT doc_id, 'blocklist' AS category, count(*) AS findings
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l JOIN terms ON contains(lower(l.line), lower(terms.term))
  GROUP BY doc_id""", """terms AS (SELECT DISTINCT trim(p) AS term FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM benchmark)
    WHERE length(trim(p)) >= 3 AND NOT starts_with(trim(p), '#'))""")
# The shapes and phrases of the privacy search and the guard, in the dialect of this engine.
SHAPES = {
    "telegram-user-id": r"\buser\d{5,}\b",
    "telegram-bot-token": r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b",
    "phone-number": r"(^|[^0-9a-fA-F])(?:\+\d{1,3}|8)[\s\-(]*\d{3}[\s\-)]*\d{3}[\s-]*\d{2}[\s-]*\d{2}($|[^0-9a-fA-F])",
    "llm-gateway-key": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "modal-token": r"\b(?:ak|as)-[A-Za-z0-9]{16,}\b",
    "hf-token": r"\bhf_[A-Za-z0-9]{20,}\b",
}
add("privacy_findings", "SELECT doc_id, category, count(*) AS findings FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS category FROM l WHERE regexp_matches(line, '{v}')" for k, v in SHAPES.items()) + ") GROUP BY doc_id, category",
    f"""l AS (SELECT * FROM (SELECT doc_id, unnest(string_split({sm.pick_sql(sm.PRIVATE_LINES, 'doc_id', 25, quote('-'))} || chr(10) || text, chr(10))) AS line FROM documents)
    WHERE NOT contains(line, 'privacy-check: allow'))""")
GAP, VERB = r"[^\p{L}\p{N}_.?!\n]", r"(?:напиши|перечисли|назови|выпиши|придумай|сгенерируй|составь|выдай|накидай)"
NUM = rf"(\d{{2,}}|сто|двести|тысяч{W}*|тыщ{W}*)"
COUNTED = rf"{VERB}{GAP}(?:[^.?!\n]{{0,28}}{GAP})?{NUM}(?:$|{NW})"
UNIT = rf"{VERB}{GAP}(?:[^.?!\n]{{0,28}}{GAP})?{NUM}\s*(?:руб|р(?:$|{NW})|₽|бакс|долл|евро|мин|час|сек|км|раз|%|процент)"
LISTOF = rf"(?:список|перечень)\s+из\s+(\d{{2,}}|сто|тысяч{W}*)"
COUNTED_EN = rf"\b(?:write|list|give me|generate|name)\b[^.?!\n]{{0,20}}?\b(\d{{2,}})\s+{W}+"


def many(pattern: str, group: int = 1) -> str:
    n = f"regexp_extract(t, '{pattern}', {group})"
    return f"(regexp_matches(t, '{pattern}') AND coalesce(TRY_CAST({n} AS DOUBLE), 1000) >= 20)"


INJECT = [
    rf"(?:игнорируй|проигнорируй|забудь|отмени|сбрось){GAP}[^.?!\n]{{0,39}}(?:инструкци|правил|промпт|указани|настройк)",
    rf"(?:покажи|выведи|раскрой|повтори|скинь|напиши)\s+(?:мне\s+)?(?:свой\s+|твой\s+)?(?:системн{W}+\s+)?(?:промпт|инструкци)",
    rf"твой\s+(?:системн{W}+\s+)?промпт|твои\s+(?:инструкции|правила)|your\s+(?:system\s+)?prompt|dan\s+mode",
    r"\bignore\s+(?:all\s+|the\s+|your\s+)?(?:previous|prior|above)\b",
    rf"(?:ты\s+теперь|отныне\s+ты|притворись|выйди\s+из\s+роли)\s+[^.?!\n]{{0,20}}(?:ии(?:$|{NW})|бот|ассистент|помощник|нейросет|модел|gpt|chatgpt)",
]
TASK = [
    rf"(?:напиши|сделай|реши|сочини|составь|переведи)\s+(?:мне\s+|за\s+меня\s+|пожалуйста\s+)*(?:код|скрипт|программу|функцию|сочинение|эссе|реферат|доклад|курсов{W}+|диплом{W}*|стих{W}*|рассказ|статью|резюме|задачу|уравнение|домашк{W}*|дз)(?:$|{NW})",
    rf"переведи{GAP}(?:[^.?!\n]{{0,38}}{GAP})?на\s+(?:английск|русск|немецк|франц|испан)",
    r"\bwrite\s+(?:me\s+)?(?:a|an|the)?\s*(?:code|script|essay|poem|program)\b",
]
add("classify_messages", f"""SELECT doc_id, CASE WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in INJECT)} THEN 'injection'
  WHEN ({many(COUNTED)} AND NOT regexp_matches(t, '{UNIT}')) OR {many(LISTOF)} OR {many(COUNTED_EN)} THEN 'bulk'
  WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in TASK)} THEN 'task'
  WHEN length(text) > 1000 THEN 'wall' END AS kind FROM (SELECT doc_id, text, replace(lower(text), 'ё', 'е') AS t FROM src)""",
    f"src AS ({documents(sm.PROVOKING, 28)})")
MARKERS = "[" + ", ".join(quote(x) for x in ASSISTANT_MARKERS) + "]"
ITEMS = rf"len(list_filter(string_split(c, chr(10)), lambda l: regexp_matches(l, '^\s*(?:\d{{1,3}}[.)]|[-•*])\s+\S')))"
SAID = f"list_filter({MARKERS}, lambda x: contains(lower(c), x))"
add("validate_replies", f"""SELECT doc_id, reason IS NULL AS ok, length(coalesce(c, '')) AS chars, reason, plan FROM (
  SELECT doc_id, plan, c, CASE WHEN message IS NULL THEN 'plan_unparsed' WHEN c = '' THEN 'empty'
    WHEN length(c) > 3000 THEN 'too_long:' || length(c) || '>3000' WHEN {ITEMS} >= 3 THEN 'list_output:' || {ITEMS}
    WHEN len({SAID}) > 0 THEN 'assistant_speak:' || {SAID}[1] END AS reason FROM d4)""",
    f"""d1 AS (SELECT doc_id, {sm.pick_sql(sm.DRAFTS, 'doc_id', 20, 'text')} AS t FROM documents),
d2 AS (SELECT doc_id, t, regexp_matches(t, '(?i)^\\s*замысел\\s*:') AS planned, regexp_matches(t, '(?is)^\\s*замысел\\s*:.*\\n\\s*ответ\\s*:') AS whole FROM d1),
d3 AS (SELECT doc_id, CASE WHEN planned AND whole THEN {strip("regexp_extract(t, '(?is)^\\s*замысел\\s*:(.*?)\\n\\s*ответ\\s*:', 1)")}
    WHEN planned THEN {strip("regexp_replace(t, '(?i)^\\s*замысел\\s*:', '')")} END AS plan,
  CASE WHEN NOT planned THEN t WHEN whole THEN {strip("regexp_extract(t, '(?is)\\n\\s*ответ\\s*:(.*)$', 1)")} END AS message FROM d2),
d35 AS (SELECT *, regexp_replace(regexp_replace({strip('message')}, '(?i)^\\s*Me\\s*[:：]\\s*', ''), '(?i)^\\s*(?:Ты|Ответ)\\s*:\\s*', '') AS c0 FROM d3),
d4 AS (SELECT doc_id, plan, message, CASE WHEN length(c0) >= 2 AND substr(c0,1,1) IN ('"', '«', '''') AND substr(c0,-1,1) IN ('"', '»', '''')
  THEN {strip('substr(c0, 2, length(c0)-2)')} ELSE c0 END AS c FROM d35)""")
add("reply_filter", f"SELECT message_id, {reply_reason('r')} AS reason FROM r",
    MESSAGES, f"r AS (SELECT message_id, {sm.pick_sql(sm.REPLIES, 'message_id', 20, 'text')} AS r FROM m)")
add("text_rules", f"""SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS key_chars, len({TOKENS.format(x='text')}) AS tokens,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*(?:[-*•]|\\d+[.)])\\s+\\S'))) AS bullets,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*-\\s+\\S'))) AS dashes,
  doc_id % 3 = 0 AS refused, length(replace(text, chr(10), ' / ')) AS flat_chars,
  strftime(make_timestamp(doc_id*1000000*1000000), '%Y') AS year FROM s""", f"s AS ({documents(sm.DRAFTS, 20)})")
add("clip_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END AS clipped FROM documents")
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
add("reply_parts", """SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS part, unnest(p) AS body FROM (
  SELECT doc_id, CASE WHEN len(l) <= 5 THEN l ELSE list_concat(l[1:4], [array_to_string(l[5:], chr(10))]) END AS p FROM s)""",
    f"s AS (SELECT doc_id, {LINES} AS l FROM documents)")
BULLETS = f"list_filter(list_transform(string_split(sheet, chr(10)), lambda l: {strip('l')}), lambda l: regexp_matches(l, '^[-•*]'))"
BODIES = f"list_transform({BULLETS}, lambda l: {strip(chr(114) + 'egexp_replace(l, ' + quote('^[-•*]+') + ', ' + quote('') + ')')})"
add("parse_fact_lines", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS BIGINT) AS place, fact FROM f
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY spot) <= 15""",
    f"""s AS (SELECT doc_id, {sm.pick_sql(sm.FACT_SHEETS, 'doc_id', 8, quote('- '))} || chr(10) || '- ' || text AS sheet FROM documents),
b AS (SELECT doc_id, unnest({BODIES}) AS body, generate_subscripts({BODIES}, 1) AS spot FROM s),
k AS (SELECT doc_id, spot, substr(body, 1, 160) AS fact FROM b WHERE body <> '' AND NOT regexp_matches(lower(body), '^(?:пока ничего|\\(пока ничего|нет фактов)')),
f AS (SELECT doc_id, spot, fact FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, lower(fact) ORDER BY spot) = 1)""")

add("knn_join", "SELECT query_id, rank, pair_id, distance FROM nn", VECTORS, neighbours("nn", "pair_id <> query_id", 8))
add("knn_join_asof", "SELECT query_id, rank, pair_id, distance FROM nn", VECTORS, neighbours("nn", "ts < query_id AND q_chat = v_chat", 8))
add("statements_anti", "SELECT query_id, pair_id, rank FROM said WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.query_id = said.query_id AND s.pair_id = said.pair_id)",
    VECTORS, neighbours("shown", "ts < query_id", 8), neighbours("said", "ts < query_id AND pair_id % 50 % 3 = 0", 4))
add("retrieval_leakage", """SELECT query_id, pair_id, CASE WHEN pair_id = query_id THEN 'target_retrieved' WHEN label = 0 THEN 'holdout_retrieved'
  ELSE 'not_earlier' END AS violation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, pair_id) AS hit FROM cand)
  WHERE hit <= 5 AND (pair_id = query_id OR label = 0 OR ts >= query_id)""", VECTORS)

add("parse_judge_scores", "SELECT run_id, pair_id, " + ", ".join(f"CASE WHEN judge_error IS NULL THEN s{i} END AS {c}" for i, c in enumerate(CRITERIA, 1)) + ", judge_error FROM rec", RECORDS)
add("parse_duel_votes", "SELECT * FROM duels", DUELS)
add("eval_summary", "SELECT run_id, n, judged, silent, fallbacks, errors, " + ", ".join(CRITERIA) + ", overall, latency_ms_p50 FROM summary", RECORDS, summary())
add("eval_per_period", "SELECT run_id, period, count(*) AS n, " + ", ".join(f"{mean3(f'CAST(sum(s{i}) AS BIGINT)', 'count(*)')} AS {c}" for i, c in enumerate(CRITERIA, 1)) +
    " FROM rec WHERE judge_error IS NULL GROUP BY run_id, period", RECORDS)
add("score_distribution", "SELECT run_id, criterion, CAST(score AS BIGINT) AS score, count(*) FILTER (WHERE value = score AND judge_error IS NULL) AS records FROM (" +
    " UNION ALL ".join(f"SELECT run_id, '{c}' AS criterion, s{i} AS value, judge_error FROM rec" for i, c in enumerate(CRITERIA, 1)) +
    "), (VALUES (1), (2), (3), (4), (5)) v(score) GROUP BY run_id, criterion, score", RECORDS)
add("worst_examples", f"""SELECT run_id, pair_id, mean, rank FROM (SELECT run_id, pair_id, mean, row_number() OVER (PARTITION BY run_id ORDER BY mean, pair_id) AS rank
  FROM (SELECT run_id, pair_id, {mean3('s1+s2+s3+s4', '4')} AS mean FROM rec WHERE judge_error IS NULL)) WHERE rank <= 10""", RECORDS)
MEASURES = ["overall", *CRITERIA]
add("compare_runs", "SELECT r.run_id, r.started_at, r.mode, r.model, r.prompt_version, b.run_id AS baseline, s.n, s.silent, " +
    ", ".join(f"s.{x}" for x in MEASURES) + ", s.latency_ms_p50, " +
    ", ".join(f"CASE WHEN r.run_id <> b.run_id THEN round(s.{x} - b.{x}, 3) END AS delta_{x}" for x in MEASURES) +
    " FROM runs r JOIN summary s USING (run_id), (SELECT * FROM summary WHERE run_id = (SELECT run_id FROM runs ORDER BY mode <> 'rag', started_at LIMIT 1)) b",
    RECORDS, summary(), RUNS)
add("compare_caveats", """SELECT 'different_samples' AS caveat, 'all' AS scope, 2 AS value WHERE FALSE
  UNION ALL SELECT 'different_sizes', 'all', count(DISTINCT n) FROM summary HAVING count(DISTINCT n) > 1
  UNION ALL SELECT 'different_judges', 'all', count(DISTINCT judge_prompt) FROM runs HAVING count(DISTINCT judge_prompt) > 1
  UNION ALL SELECT 'different_style_profiles', prompt_version, count(DISTINCT coalesce(profile, 'untracked')) FROM runs GROUP BY prompt_version HAVING count(DISTINCT coalesce(profile, 'untracked')) > 1
  UNION ALL SELECT 'duplicate_pair_ids', run_id, count(*) - count(DISTINCT pair_id) FROM twice GROUP BY run_id HAVING count(*) > count(DISTINCT pair_id)
  UNION ALL SELECT 'unjudged', run_id, n - judged FROM summary WHERE judged < n
  UNION ALL SELECT 'silent', run_id, silent FROM summary WHERE silent > 0
  UNION ALL SELECT 'fallbacks', run_id, fallbacks FROM summary WHERE fallbacks > 0""",
    RECORDS, "twice AS (SELECT * FROM rec UNION ALL SELECT * FROM rec WHERE run = 2 AND lang = 'es')", summary("twice"), RUNS)
add("duel_join", """SELECT a.pair_id, length(a.output) AS a_chars, length(b.output) AS b_chars FROM rec a JOIN rec b USING (pair_id)
  WHERE a.run = 1 AND b.run = 3""", RECORDS)
add("duel_summary", """SELECT n, a_wins, b_wins, ties, errors, CASE WHEN a_wins + b_wins = 0 THEN 1.0 ELSE round(least(1.0, 2*(
    SELECT sum(exp(lgamma(a_wins+b_wins+1) - lgamma(i+1) - lgamma(a_wins+b_wins-i+1) - (a_wins+b_wins)*ln(2.0)))
    FROM range(0, least(a_wins, b_wins) + 1) t(i))), 4) END AS p_value
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE outcome='a') AS a_wins, count(*) FILTER (WHERE outcome='b') AS b_wins,
    count(*) FILTER (WHERE outcome='tie') AS ties, count(*) FILTER (WHERE has_error) AS errors FROM duels)""", DUELS)

CHAT = """
ex AS (
  SELECT pair_id, reply, '<|im_start|>system' || chr(10) || 'Ты — Me. Отвечай так, как ответил бы Me.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) ||
    {ctx} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM train),
examples AS (SELECT pair_id, prompt || reply || '<|im_end|>' || chr(10) AS text, length(prompt) AS prompt_tokens, length(reply) AS reply_tokens FROM ex)""".format(ctx=transcript("context"))
add("train_examples", "SELECT pair_id, text, length(text) AS tokens, prompt_tokens, reply_tokens FROM examples", SPLIT, CHAT)
add("train_manifest", f"""SELECT (SELECT count(*) FROM fit) AS examples, (SELECT count(*) FROM examples) - (SELECT count(*) FROM fit) AS dropped_too_long,
  CAST(sum(tokens) AS BIGINT) AS tokens_total, {quantile('tokens', 0.5)} AS tokens_p50, {quantile('tokens', 0.9)} AS tokens_p90, max(tokens) AS tokens_max,
  {quantile('reply_tokens', 0.5)} AS reply_tokens_p50 FROM fit""", SPLIT, CHAT, "fit AS (SELECT *, length(text) AS tokens FROM examples WHERE length(text) <= 1500)")
add("train_eval_split", """SELECT pair_id, CASE WHEN n >= 20 AND rn <= greatest(1, CAST(floor(n*0.1) AS BIGINT)) THEN 'eval' ELSE 'train' END AS part FROM (
  SELECT pair_id, count(*) OVER () AS n, row_number() OVER (ORDER BY sha256('7:' || pair_id), pair_id) AS rn FROM train)""", SPLIT)
FLAT_CLIP = "CASE WHEN length(replace({x}, chr(10), ' / ')) > {n} THEN substr(replace({x}, chr(10), ' / '), 1, {n}-1) || '…' ELSE replace({x}, chr(10), ' / ') END"
EXAMPLES = f"""array_to_string(list_transform({THEIRS}, lambda t: 'Собеседник: ' || {FLAT_CLIP.format(x='t.text', n=300)} || chr(10) || 'Me: ' || reply), chr(10) || chr(10))"""
KNOW = f"""concat_ws(chr(10) || chr(10),
  CASE WHEN ts % 200 = 0 THEN '### Me: earlier statements' || chr(10) || '- [' || period || '] ' || {FLAT_CLIP.format(x='reply', n=300)} END,
  CASE WHEN ts % 300 = 0 THEN '### Partner: notes' || chr(10) || '- факт' END)"""
add("prompt_table", f"""SELECT pair_id, regexp_replace('Me' || chr(10) || 'стиль' || chr(10) || CASE WHEN len({THEIRS}) > 0 THEN {EXAMPLES} ELSE '(примеров нет)' END || chr(10) || chr(10) || {KNOW} || chr(10) || chr(10) || 'конец', '\\n{{3,}}', chr(10) || chr(10), 'g') AS system,
  regexp_replace(CASE WHEN len(context) > 1 THEN {transcript('context[:-2]')} ELSE '(начало разговора)' END || chr(10) || '### ' || context[-1].text || chr(10) || 'Me:', '\\n{{3,}}', chr(10) || chr(10), 'g') AS user FROM pairs""", OWN)
add("chunk_render", f"""SELECT chunk, count(*) AS pairs, arg_min(period, n) || ' — ' || arg_max(period, n) AS period, string_agg(line, chr(10) ORDER BY n) AS text FROM (
  SELECT n, (n-1) // 40 AS chunk, period, '[' || period || '] Собеседник: ' || CASE WHEN length(p) > 200 THEN substr(p, 1, 199) || '…' ELSE p END || chr(10) || 'Me: ' || {strip("replace(reply, chr(10), ' / ')")} AS line FROM (
    SELECT period, reply, {strip(f"replace(coalesce({THEIRS}[-1].text, ''), chr(10), ' / ')")} AS p, row_number() OVER (ORDER BY ts, pair_id) AS n FROM train WHERE length({strip('reply')}) >= 20))
  GROUP BY chunk""", SPLIT)

add("rolling_counts", """SELECT chat_id, ts, CAST(max(h) AS BIGINT) AS replies_hour, CAST(max(d) AS BIGINT) AS replies_day, CAST(max(p) AS BIGINT) AS provocations_hour FROM (
  SELECT chat_id, ts, sum(CASE WHEN origin='bot' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS h,
    sum(CASE WHEN origin='bot' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS d,
    sum(CASE WHEN kind='bulk' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS p FROM live) GROUP BY chat_id, ts""", LIVE)
add("provocation_gate", """SELECT a.chat_id, a.message_id, count(*) AS in_hour, count(*) > 2 AS ignored FROM p a JOIN p b ON a.chat_id = b.chat_id
  AND b.ts > a.ts - 3600 AND (b.ts, b.message_id) <= (a.ts, a.message_id) GROUP BY a.chat_id, a.message_id""", LIVE, "p AS (SELECT * FROM live WHERE kind IS NOT NULL)")
PAUSED = """
seen AS (SELECT *, max(CASE WHEN {owner} THEN ts END) OVER (PARTITION BY chat_id ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner_ts FROM {source})"""
add("autopause", """SELECT chat_id, message_id, ts, CASE WHEN origin='owner' THEN 'owner_message_autopause' WHEN owner_ts + 1800 > ts THEN 'paused' ELSE 'pass' END AS outcome
  FROM seen WHERE origin <> 'bot'""", LIVE, PAUSED.format(owner="origin='owner'", source="live"))
add("rate_limit", """SELECT chat_id, message_id, ts, CASE WHEN list_contains(passed, ts*10000000 + message_id) THEN 'pass' ELSE 'rate_limited' END AS outcome
  FROM c JOIN p USING (chat_id)""", LIVE, "c AS (SELECT * FROM live WHERE origin='partner')", f"p AS (SELECT chat_id, {rolled(3, 40)} AS passed FROM c GROUP BY chat_id)")
add("gate_messages", """SELECT chat_id, message_id, ts, CASE WHEN g2 IS NOT NULL THEN g2 WHEN in_hour > 2 THEN 'provocation_ignored'
    WHEN hour_n >= 3 OR day_n >= 40 THEN 'rate_limited' WHEN skip THEN 'skipped' ELSE 'pass' END AS outcome FROM (
  SELECT s.*, i.in_hour, a.skip, (SELECT count(*) FROM passes p WHERE p.chat_id = s.chat_id AND p.ts > s.ts - 3600 AND (p.ts, p.message_id) < (s.ts, s.message_id)) AS hour_n,
    (SELECT count(*) FROM passes p WHERE p.chat_id = s.chat_id AND p.ts > s.ts - 86400 AND (p.ts, p.message_id) < (s.ts, s.message_id)) AS day_n
  FROM g2 s LEFT JOIN inhour i USING (chat_id, message_id) LEFT JOIN asking a USING (chat_id, message_id))""",
    LIVE, """g1 AS (SELECT *, CASE WHEN user_id%97=0 THEN 'no_connection' WHEN user_id%89=0 THEN 'connection_mismatch' WHEN user_id%83=0 THEN 'not_private'
    WHEN user_id%79=0 THEN 'no_sender' WHEN origin='bot' THEN 'own_bot_message' WHEN origin='owner' THEN 'owner_message_autopause'
    WHEN user_id%7=0 THEN 'not_allowed' WHEN user_id%61=0 THEN 'disabled' END AS g1 FROM live)""",
    PAUSED.format(owner="g1='owner_message_autopause'", source="g1"),
    "g2 AS (SELECT *, coalesce(g1, CASE WHEN owner_ts + 1800 > ts THEN 'paused' WHEN text = '' THEN 'non_text' END) AS g2 FROM seen)",
    """pv AS (SELECT * FROM g2 WHERE g2 IS NULL AND kind IS NOT NULL),
inhour AS (SELECT a.chat_id, a.message_id, count(*) AS in_hour FROM pv a JOIN pv b ON a.chat_id = b.chat_id AND b.ts > a.ts - 3600
  AND (b.ts, b.message_id) <= (a.ts, a.message_id) GROUP BY a.chat_id, a.message_id)""",
    f"asking AS (SELECT s.chat_id, s.message_id, s.ts, NOT contains(text, '?') AND {fraction(chr(39) + 'skip:' + chr(39) + ' || s.chat_id || ' + chr(39) + ':' + chr(39) + ' || s.message_id')} < 0.05 AS skip FROM g2 s LEFT JOIN inhour i USING (chat_id, message_id) WHERE g2 IS NULL AND coalesce(in_hour, 0) <= 2)",
    f"pl AS (SELECT chat_id, unnest({rolled(3, 40)}) AS code FROM asking WHERE NOT skip GROUP BY chat_id), passes AS (SELECT chat_id, code // 10000000 AS ts, code % 10000000 AS message_id FROM pl)")
add("recent_memory", """SELECT chat_id, back, message_id, is_me, CASE WHEN flagged AND chars > 200 THEN 200 ELSE chars END AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, message_id DESC) AS back FROM turns) WHERE back <= 10""", MEMORY)
add("human_turns", "SELECT chat_id, is_me, count(*) AS turns FROM turns WHERE NOT by_bot AND NOT flagged GROUP BY chat_id, is_me", MEMORY)
add("previous_partner_text", """SELECT chat_id, message_id, last_value(CASE WHEN NOT is_me THEN text END IGNORE NULLS) OVER (
  PARTITION BY chat_id ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM m""", MESSAGES)
add("last_activity", """SELECT chat_id, max(ts) FILTER (WHERE origin='partner') AS last_incoming_ts, max(ts) FILTER (WHERE origin<>'partner') AS last_outgoing_ts,
  max(ts) FILTER (WHERE origin='bot') AS last_bot_reply_ts, max(ts) AS last_activity_ts,
  coalesce(max(ts + 1) FILTER (WHERE origin='bot') > coalesce(max(ts) FILTER (WHERE origin='partner'), 0), false) AS peer_blocked FROM live GROUP BY chat_id""", LIVE)
add("followup_due", f"""SELECT chat_id, message_id, ts, CASE
    WHEN EXISTS (SELECT 1 FROM live o WHERE o.chat_id=r.chat_id AND o.origin<>'partner' AND o.ts > r.ts AND o.ts <= r.ts+1200) THEN 'later_outgoing_message'
    WHEN EXISTS (SELECT 1 FROM live o WHERE o.chat_id=r.chat_id AND o.origin='partner' AND o.ts > r.ts AND o.ts <= r.ts+1200) THEN 'partner_spoke_last'
    WHEN {fraction("'initiative:' || chat_id || ':' || ts")} >= 0.5 THEN 'rolled_no' ELSE 'ok' END AS outcome FROM live r WHERE origin='bot'""", LIVE)
add("opener_plan", f"""SELECT chat_id, strftime(day, '%Y-%m-%d') AS day, moment AS "at", CASE WHEN moment IS NULL THEN 'no_opener_today'
    WHEN moment - (SELECT max(ts) FROM live l WHERE l.chat_id = d.chat_id AND l.ts <= moment) < 900 THEN 'not_silent' ELSE 'ok' END AS outcome FROM (
  SELECT chat_id, day, CASE WHEN {fraction("'initiative:roll:' || chat_id || ':' || strftime(day, '%Y-%m-%d')")} < 0.6 THEN CAST(epoch(day) AS BIGINT) - 10800 + 36000 +
    CAST(floor({fraction("'initiative:time:' || chat_id || ':' || strftime(day, '%Y-%m-%d')")} * 14400) AS BIGINT) END AS moment FROM (
    SELECT chat_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM (
      SELECT chat_id, date_trunc('day', make_timestamp((min(ts)+10800)*1000000)) AS a, date_trunc('day', make_timestamp((max(ts)+10800)*1000000)) AS b FROM live GROUP BY chat_id))) d""", LIVE)
add("hourly_counts", "SELECT chat_id, ts // 3600 * 3600 AS hour_ts, count(*) AS messages FROM live GROUP BY 1, 2", LIVE)
add("session_counts", """SELECT chat_id, session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS messages FROM (
  SELECT chat_id, ts, CAST(sum(brk) OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, message_id) > 3600 THEN 1 ELSE 0 END AS brk FROM live)) GROUP BY chat_id, session""", LIVE)


def over(bucket: str, seconds: int, limit: int) -> str:
    return f"""SELECT '{bucket}' AS bucket, count(*) AS active, count(*) FILTER (WHERE k > {limit}) AS over_budget,
  ((20000*count(*) FILTER (WHERE k > {limit}) + count(*)) // (2*count(*)))/100.0 AS over_pct FROM (SELECT count(*) AS k FROM live GROUP BY chat_id, ts // {seconds})"""


add("budget_backtest", over("hour", 3600, 3) + " UNION ALL " + over("day", 86400, 40), LIVE)
add("learning_due", """SELECT chat_id, o[1] AS due_ts, o[2] AS turns FROM (SELECT chat_id, unnest(CASE WHEN n >= 6 THEN list_append(outs, [last + 21600, n]) ELSE outs END) AS o FROM (
  SELECT chat_id, r.last AS last, r.n AS n, r.outs AS outs FROM (SELECT chat_id, list_reduce(
    list({'last': CAST(ts AS BIGINT), 'n': CAST(k AS BIGINT), 'outs': CAST([] AS BIGINT[][])} ORDER BY ts),
    lambda acc, x: CASE WHEN acc.n >= 6 AND acc.last + 21600 < x.last THEN
        CASE WHEN x.n >= 6 AND x.last - acc.last - 21600 >= 21600
          THEN {'last': x.last, 'n': CAST(0 AS BIGINT), 'outs': list_concat(acc.outs, [[acc.last + 21600, acc.n], [x.last, x.n]])}
          ELSE {'last': acc.last + 21600, 'n': x.n, 'outs': list_append(acc.outs, [acc.last + 21600, acc.n])} END
      WHEN acc.n + x.n >= 6 AND x.last - acc.last >= 21600
        THEN {'last': x.last, 'n': CAST(0 AS BIGINT), 'outs': list_append(acc.outs, [x.last, acc.n + x.n])}
      ELSE {'last': acc.last, 'n': acc.n + x.n, 'outs': acc.outs} END,
    {'last': CAST(-21600 AS BIGINT), 'n': CAST(0 AS BIGINT), 'outs': CAST([] AS BIGINT[][])}) AS r
    FROM (SELECT chat_id, ts, count(*) AS k FROM turns WHERE NOT by_bot AND NOT flagged GROUP BY 1, 2) GROUP BY chat_id)))""", MEMORY)
add("edit_origin", """SELECT e.chat_id, e.message_id, e.ts, coalesce(bool_or(s.number <= e.number AND e.number - s.number < 100), false) AS by_bot
  FROM (SELECT * FROM timeline WHERE step = 1) e LEFT JOIN (SELECT * FROM timeline WHERE step = 0) s USING (chat_id, message_id) GROUP BY 1, 2, 3""", LIVE,
    """timeline AS (SELECT *, sum(1 - step) OVER (PARTITION BY chat_id ORDER BY ts, step, message_id ROWS UNBOUNDED PRECEDING) AS number FROM (
    SELECT chat_id, message_id, ts, 0 AS step FROM live WHERE origin='bot'
    UNION ALL SELECT chat_id, message_id, ts + message_id % 5 * 100000, 1 FROM live))""")
add("allowed_messages", """SELECT chat_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AS allowed, count(*) AS messages
  FROM live GROUP BY 1, 2""", LIVE)
add("period_means", "SELECT run_id, period, n, ((" + " + ".join(f"CAST(round({c}*1000) AS BIGINT)" for c in CRITERIA) + ") + 20) // 40 / 100.0 AS mean FROM pp",
    RECORDS, "pp AS (" + ORACLE["eval_per_period"].split("\n", 1)[1][ORACLE["eval_per_period"].split("\n", 1)[1].index("SELECT run_id, period"):] + ")")
add("first_examples", "SELECT pair_id, length(text) AS tokens FROM examples WHERE length(text) <= 1500 ORDER BY pair_id LIMIT 50", SPLIT, CHAT)

add("parse_int_field", f"""SELECT event_id, CASE WHEN regexp_matches({strip('x')}, '^-?\\d+$') THEN CAST({strip('x')} AS BIGINT) END AS number FROM (
  SELECT event_id, {sm.pick_sql(sm.INTEGERS, 'event_id', 16, 'CAST(event_id AS VARCHAR)')} AS x FROM events)""")
add("parse_sender", f"""SELECT event_id, CASE WHEN ok THEN regexp_extract(x, '^(user|channel|chat)', 1) END AS prefix, CASE WHEN ok THEN CAST(regexp_extract(x, '(-?\\d+)$', 1) AS BIGINT) END AS id FROM (
  SELECT event_id, x, regexp_full_match(x, '(user|channel|chat)-?\\d+') AS ok FROM (SELECT event_id, {sm.pick_sql(sm.SENDERS, 'event_id', 14, "'user' || user_id")} AS x FROM events))""")
add("parse_timestamp", "SELECT pos, stamp AS ts, CASE WHEN unix IS NOT NULL THEN 'date_unixtime' WHEN local IS NOT NULL THEN 'date_local' END AS source FROM cls", RAW)
add("classify_record", "SELECT chat_id, pos, reason, kind FROM cls", RAW)
add("to_messages", """SELECT record_id AS message_id, chat_id, stamp AS ts, CAST(substr(from_id, 5) AS BIGINT) AS sender_id, from_id='user1001' AS is_me, text,
  reply_to AS reply_to_message_id, is_forwarded, coalesce(media, payload) AS media_type, CASE WHEN unix IS NOT NULL THEN 'date_unixtime' ELSE 'date_local' END AS ts_source,
  false AS reply_id_unparsed FROM cls WHERE reason IS NULL""", RAW)
add("drop_counts", """SELECT CASE WHEN chat_id=3 THEN 'chat_type_skipped' ELSE reason END AS reason, CASE WHEN chat_id=3 THEN chat_type ELSE coalesce(kind, '') END AS kind, count(*) AS records
  FROM cls WHERE chat_id=3 OR reason IS NOT NULL GROUP BY 1, 2""", RAW)
add("chat_summary", """SELECT chat_id, chat_type, count(*) AS raw_messages, count(*) FILTER (WHERE chat_id<>3 AND reason IS NULL) AS kept_messages,
  count(*) FILTER (WHERE chat_id<>3 AND reason IS NULL AND from_id='user1001') AS me_messages FROM cls GROUP BY 1, 2""", RAW)
add("top_senders", """SELECT from_id, count(*) AS messages FROM cls WHERE chat_id<>3 AND type='message' GROUP BY from_id ORDER BY messages DESC, min(pos) LIMIT 3""", RAW)
add("local_utc_offsets", """SELECT '+' || (local - unix) AS "offset", count(*) AS messages FROM cls WHERE reason IS NULL AND unix IS NOT NULL AND local IS NOT NULL GROUP BY 1""", RAW)
add("reply_target_audit", """SELECT count(*) AS replies, count(*) FILTER (WHERE t.kept IS NULL) AS reply_target_missing, count(*) FILTER (WHERE NOT t.kept) AS reply_target_dropped
  FROM (SELECT * FROM cls WHERE chat_id<>3 AND reason IS NULL AND reply_to IS NOT NULL) k
  LEFT JOIN (SELECT chat_id, record_id, bool_or(reason IS NULL) AS kept FROM cls WHERE chat_id<>3 AND record_id IS NOT NULL GROUP BY 1, 2) t ON t.chat_id=k.chat_id AND t.record_id=k.reply_to""", RAW)

add("pairs_since", "SELECT pair_id, ts FROM pairs WHERE ts >= 1705708800", OWN)
add("first_eval_records", "SELECT pair_id, ts FROM split_pairs WHERE eval_sample ORDER BY ts, pair_id LIMIT 20", SPLIT)
add("style_sample", """SELECT pair_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY draw, pair_id) AS pos FROM drawn) JOIN given USING (y) WHERE pos <= share""",
    OWN, """drawn AS (SELECT pair_id, ts, substr(period, 1, 4) AS y, sha256('7:' || pair_id) AS draw FROM pairs),
years AS (SELECT y, count(*) AS size, sum(count(*)) OVER () AS p FROM drawn GROUP BY y),
parts AS (SELECT y, size * least(60, p) // p AS base, size * least(60, p) % p AS rest, least(60, p) AS t FROM years),
given AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM parts)""")
add("sender_counts", "SELECT from_id AS sender_raw_id, count(*) AS messages FROM cls WHERE reason IS NULL GROUP BY 1", RAW)
add("anomaly_counts", """SELECT CAST(0 AS BIGINT) AS text_entities_mismatch, count(*) FILTER (WHERE pos % 47 = 0) AS edited_unixtime_unparsed,
  CAST(0 AS BIGINT) AS reply_id_unparsed FROM cls WHERE reason IS NULL""", RAW)
add("messages_manifest", """SELECT count(*) AS raw_messages, count(*) FILTER (WHERE chat_id <> 3 AND reason IS NULL) AS kept_messages,
  min(stamp) FILTER (WHERE chat_id <> 3 AND reason IS NULL) AS ts_min, max(stamp) FILTER (WHERE chat_id <> 3 AND reason IS NULL) AS ts_max,
  'full_export' AS export_kind, (SELECT '{' || string_agg('"' || r || '":' || n, ',' ORDER BY n DESC, r) || '}' FROM (
    SELECT CASE WHEN chat_id = 3 THEN 'chat_type_skipped' ELSE reason END AS r, count(*) AS n FROM cls WHERE chat_id = 3 OR reason IS NOT NULL GROUP BY 1)) AS dropped,
  count(DISTINCT chat_id) AS chats, count(DISTINCT from_id) FILTER (WHERE chat_id <> 3 AND reason IS NULL) AS senders FROM cls""", RAW)
add("value_quantiles", f"""SELECT o_orderpriority, count(cents) AS n, {quantile('cents', 0.5)} AS p50, {quantile('cents', 0.9)} AS p90, {quantile('cents', 0.99)} AS p99,
  max(cents) AS max, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) GROUP BY 1""")
add("dataset_manifest", f"""SELECT (SELECT CAST(sum(t) AS BIGINT) FROM per_chat) AS turns, (SELECT CAST(sum(c) AS BIGINT) FROM per_chat) AS conversations,
  (SELECT count(*) FROM judged) AS own_turns, (SELECT count(*) FROM judged WHERE drop_reason IS NULL) AS pairs_kept,
  count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'holdout') AS holdout, count(*) FILTER (WHERE eval_sample) AS eval_sample,
  count(*) FILTER (WHERE length(reply) > 2000) AS replies_over_max,
  {", ".join(f"{quantile(value, q)} AS {m}_{p}" for m, value in (("reply", "length(reply)"), ("turns", "len(context)")) for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))},
  max(length(reply)) AS reply_max, max(len(context)) AS turns_max, (SELECT count(*) FROM judged WHERE drop_reason IS NOT NULL) AS pairs_dropped,
  count(*) FILTER (WHERE eval_sample) AS eval_sample_by_period, count(*) AS per_year, count(DISTINCT chat_id) AS chats, count(*) FILTER (WHERE split = 'train') AS chats_train
  FROM split_pairs""", SPLIT, "per_chat AS (SELECT chat_id, count(*) AS t, max(conv) + 1 AS c FROM cx GROUP BY chat_id)")
ORACLE["knn_join_pivots"] = ORACLE["knn_join"]


def hashed_vector(x: str) -> str:
    """Unit vector of signed word counts in 64 places, as FLOATs seen as DOUBLEs."""
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    places = f"list_transform({words}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128)"
    return f"(SELECT list_transform(c, lambda v: CAST(CAST(v / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-9) AS FLOAT) AS DOUBLE)) FROM (SELECT list_transform(range(0, 64), lambda d: CAST(len(list_filter(p, lambda z: z = d)) - len(list_filter(p, lambda z: z = d + 64)) AS DOUBLE)) AS c FROM (SELECT {places} AS p)))"


REPLY_KEY = "regexp_replace(lower(reply), '[^\\p{L}\\p{N}]+', '', 'g')"
add("retrieval", "SELECT query_id, rank, pair_id, distance FROM nn", SPLIT, f"""docs AS (
  SELECT pair_id, chat_id, ts, reply, array_to_string(list_transform(CASE WHEN len({THEIRS}) > 0 THEN {THEIRS}[-2:] ELSE context[-2:] END, lambda t: t.text), chr(10)) AS words FROM train),
asks AS (
  SELECT pair_id, chat_id, ts, array_to_string(list_filter([list_filter(context[:-2], lambda t: NOT t.is_me)[-1].text, context[-1].text], lambda t: t IS NOT NULL AND t <> ''), chr(10)) AS words
  FROM split_pairs WHERE split = 'holdout'),
index_vec AS MATERIALIZED (SELECT pair_id, chat_id, ts, {REPLY_KEY} AS reply_key, {hashed_vector('words')} AS e FROM docs),
ask_vec AS MATERIALIZED (SELECT pair_id, chat_id, ts, {hashed_vector('words')} AS e FROM asks),
cand AS (
  SELECT q.pair_id AS query_id, v.pair_id, v.reply_key, v.ts, round(1.0 - coalesce(list_cosine_similarity(q.e, v.e), 0), 6) AS distance
  FROM ask_vec q JOIN index_vec v ON v.chat_id = q.chat_id AND v.ts < q.ts)""", neighbours("nn", "true", 8))

# --- streams: the whole result of the batch operators -----

add("stream_enrich", f"""SELECT doc_id, kind, least(length(t5), 1000) AS chars FROM c5 JOIN k USING (doc_id)""",
    cleaned().replace(documents(sm.CONTACTS, 20), documents(sm.CONTACTS + sm.PROVOKING, 40)),
    "k AS (" + ORACLE["classify_messages"].replace(documents(sm.PROVOKING, 28), documents(sm.CONTACTS + sm.PROVOKING, 40)) + ")")
add("stream_hourly_counts", "SELECT chat_id, CAST(ts // 3600 * 3600 AS BIGINT) AS bucket_ts, count(*) AS messages FROM live GROUP BY 1, 2", LIVE)
add("stream_turns", "SELECT chat_id, sender_id, is_me, start_ts, end_ts, n_messages, text, own_text FROM turns", TURNS)
ORACLE["stream_sessions"] = f"SELECT chat_id, start_ts, end_ts, messages FROM ({ORACLE['session_counts']})"
for batch in ("gate_messages", "rate_limit", "followup_due", "learning_due", "edit_origin"):
    ORACLE[{"gate_messages": "stream_gate", "followup_due": "stream_followup", "learning_due": "stream_learning", "edit_origin": "stream_edits"}.get(batch, f"stream_{batch}")] = ORACLE.get(batch, "")
for name, batch in (("stream_memory", "recent_memory"), ("stream_last_activity", "last_activity"), ("learning_due_slices", "learning_due"), ("rate_limit_slices", "rate_limit")):
    ORACLE[name] = ORACLE[batch]
add("stream_opener", f"""SELECT chat_id, day, o."at" AS "at", outcome FROM ({ORACLE["opener_plan"]}) o
  JOIN (SELECT chat_id, min(ts) AS first_ts FROM live GROUP BY 1) USING (chat_id) WHERE o."at" >= first_ts""", LIVE)
ORACLE = {name: sql for name, sql in ORACLE.items() if sql}
