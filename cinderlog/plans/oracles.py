"""The registered queries once more, as plain SQL for another engine.

That engine's patterns have no lookaround, so the two server masks are written
as list and string steps: with K the place where the later of "last digit" and
"last letter" stops holding, a whole token goes when it has the separator past
its start and before K.
"""

from __future__ import annotations

from cinderlog.functions import masks, prompts
from cinderlog.functions.text import WHITESPACE
from cinderlog.operators.scoring import ALARM_WORDS
from cinderlog.plans.views import CAPS, MIXES

WS = "'" + WHITESPACE + "'"
GAP = "'[" + WHITESPACE + "]+'"

LOG_LINES = """SELECT event_id AS line_id, concat_ws(' ',
 CASE WHEN event_type<>'error' THEN '-' WHEN event_id%2=0 THEN 'EVTFAIL' ELSE 'EVTSTOP' END,
 cast(epoch_us(ts)//1000000 AS varchar), strftime(ts,'%Y.%m.%d'), NODE,
 strftime(ts,'%Y-%m-%d-%H.%M.%S.%f'), NODE, 'RAS',
 CASE event_id%3 WHEN 0 THEN 'KERNEL' WHEN 1 THEN 'APP' ELSE 'MMCS' END,
 CASE WHEN event_type='error' OR event_id%7=0 THEN 'FATAL' ELSE 'INFO' END,
 CASE event_type
  WHEN 'view' THEN 'read block blk_'||(100+user_id)||' from 10.0.'||(user_id%256)||'.'
    ||(event_id%256)||':'||(5000+event_id%1000)
  WHEN 'click' THEN 'opened /srv/u'||user_id||'/f'||(event_id%7)||' in '||(event_id%90)||' ms'
  WHEN 'signup' THEN 'unit u-'||user_id||' joined, word 0x'||(1000+event_id%9000)||'ab'
  WHEN 'purchase' THEN 'moved blk_'||(100+user_id)||' to blk_-'||(100+event_id%50)||' ok'
  ELSE CASE event_id%3
    WHEN 0 THEN 'gate closed at addr 00'||(100000+event_id%1000)||', halted'
    WHEN 1 THEN 'lost peer u-'||user_id||': no answer' ELSE 'halted without cause' END END) AS line
 FROM events""".replace(
    "NODE",
    "'R'||(10+user_id%64)||'-M'||(event_id%2)||'-N'||(event_id%10)||'-C:J'||(10+event_id%18)||'-U01'",
)

CLUSTER_LINES = """SELECT event_id AS line_id,
 (CASE WHEN event_type<>'error' THEN '-' ELSE 'VAPI' END)||' '||(1100000000+event_id)||' '
 ||strftime(ts,'%Y.%m.%d')||' n'||user_id||' '
 ||(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month(ts)]
 ||' '||day(ts)||' '||strftime(ts,'%H:%M:%S')||' u'||user_id||'@host-'||(event_id%9)||' '
 ||CASE event_id%4
   WHEN 0 THEN 'crond['||event_id||']: run /etc/cron.d/x job'
   WHEN 1 THEN 'sshd from 10.1.'||(user_id%256)||'.7:22 key ab'||(10000000+event_id)||'ff'
   WHEN 2 THEN 'mail to bob.x@site.org via lib/a/b'||(event_id%5)
   ELSE 'disk /dev['||(event_id%8)||'] fault' END AS line FROM events"""

DOC_LINES = """SELECT doc_id, pos, l[pos] AS line FROM (SELECT doc_id, l,
 unnest(range(1, len(l)+1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l
 FROM documents))"""

SCORED = """SELECT event_id AS id, CASE WHEN event_type='error' THEN 1 ELSE 0 END AS label,
 ((event_id*7919)%100 + CASE WHEN event_type='error' THEN 30 ELSE 0 END)/100.0::DOUBLE AS score,
 value*10::DOUBLE AS ms FROM events"""
SCORED = f"""SELECT *, CASE WHEN id%11=0 THEN -1 WHEN score>=0.6::DOUBLE THEN 1 ELSE 0 END AS pred
 FROM ({SCORED})"""

ANSWERS = """SELECT conv_id*1000+turn AS id, '  '||text||' '||chr(9) AS line, CASE (conv_id+turn)%10
 WHEN 0 THEN '0' WHEN 1 THEN '1'||chr(10)||text WHEN 2 THEN '<think>'||text||chr(10)||'0</think> so 1'
 WHEN 3 THEN '<think> not closed 1 '||text WHEN 4 THEN text||' so 1, not 0' WHEN 5 THEN 'x10y'
 WHEN 6 THEN to_json({'Label': '1', 'line': text})::VARCHAR WHEN 7 THEN '{''Label'': ''1''} '||text
 WHEN 8 THEN '{"Label": "1", "Label": "0", "line": "x"}' ELSE text END AS response
 FROM conversations"""

VEC = """SELECT vec_id, label, label < 8 AND vec_id%5 <> 0 AS in_bank,
 list_transform(range(0,8), lambda i: list_transform(embedding[i*8+1:i*8+8],
   lambda x: x::DOUBLE)) AS tokens,
 list_transform(embedding[1:8], lambda x: x::DOUBLE) AS first FROM embeddings"""


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n"


def tokens(col: str) -> str:
    return f"string_split_regex(trim({col},{WS}), {GAP})"


def normalised(col: str) -> str:
    return (
        f"trim(regexp_replace(strip_accents(lower(trim({col},{WS}))),'[^a-zA-Z<>]+',' ','g'))"
    )


def key(seed: int, id_: str) -> str:
    return f"md5('{seed}|'||{id_})"


# --- masks: the patterns are fixed values ------------------------------------

IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?"
STAMP = r"\d{1,4}-\d{1,2}-\d{1,2}-\d{1,2}\.\d{1,2}\.\d{1,2}\.\d{1,6}"


def chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, mask in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{mask}', 'g')"
    return expr


def server(src: str, sep: str, name: str) -> list[tuple[str, str]]:
    """Steps that replace whole tokens with a separator, from CTE to CTE."""
    return [
        (f"{name}a", f"""SELECT *, least(length(regexp_extract(t,'(?s)^(.*)[0-9]',1)),
          length(regexp_extract(t,'(?s)^(.*)[A-Za-z]',1))) AS h FROM {src}"""),
        (f"{name}b", f"""SELECT *, regexp_extract(left(t,h),'\\S*$') AS sh,
          regexp_extract(substr(t,h+1),'^\\S*') AS st FROM {name}a"""),
        (name, f"""SELECT * EXCLUDE (t,h,sh,st),
          regexp_replace(left(t,h-length(sh)),'\\S+{sep}\\S*',' SERVER ','g')
          || CASE WHEN regexp_matches(sh,'^\\S+{sep}') THEN ' SERVER ' ELSE sh||st END
          || substr(t,h+length(st)+1) AS t FROM {name}b"""),
    ]


def mask_bgl(src: str) -> list[tuple[str, str]]:
    """CTEs from ``src`` (with ``line``) to ``masked`` (with ``t``)."""
    early = chain(f"trim(line,{WS})", [
        (STAMP, " TIME "), (IP, " IP "), (r"\d{1,4}\.\d{1,2}\.\d{1,2}", " TIME "),
        (r".\S+/[0-9a-zA-Z]\S*", " PATH "),
    ])
    late = chain("t", [
        ("[A-Z0-9]{28}", " ECID "), ("[a-zA-Z0-9]{48}", " SERIAL "),
        (r"0[xX][0-9a-fA-F]\S+", " MEMORY "), ("[0-9a-fA-F]{8}", " IAR "), (r"\d+", " NUM "),
    ])
    return [
        ("early", f"SELECT *, {early} AS t FROM {src}"),
        *server("early", ":", "colon"),
        *server("colon", "-", "hyphen"),
        ("masked", f"SELECT * EXCLUDE (t), {late} AS t FROM hyphen"),
    ]


PATH_CHARS = r"[a-zA-Z0-9_\-./]"
THUNDERBIRD = chain("line", [
    (r"\d{2,4}\.\d{1,2}\.\d{1,2}\s", "DATE "),
    (r"(Jan(uary)?|Feb(ruary)?|Mar(ch)?|Apr(il)?|May|June?|July?|Aug(ust)?|Sep(tember)?"
     r"|Oct(ober)?|Nov(ember)?|Dec(ember)?)\s+\d{1,2}\s+", "DATE "),
    (r"DATE\s.*\sDATE", "DATE ID DATE"),
    (r"\d{1,2}:\d{1,2}:\d{1,2}", "TIME"),
    (r"TIME\s\S+", "TIME ACCOUNT"),
    (r"\w[\w.]*@\w[\w.]*-\w[\w.]*", "ACCOUNT"),
    (r"\w[\w.]*@\w[\w.]*", "ACCOUNT"),
    (f"{PATH_CHARS}+/{PATH_CHARS}+/{PATH_CHARS}*", " DIR "),
    (f"/{PATH_CHARS}+/{PATH_CHARS}*", " DIR "),
    (IP, "IP"),
    ("[0-9a-fA-F]{10}", "IAR"),
    (r"\[\d+\]", " NUM "),
])


def hdfs(col: str) -> str:
    return chain(col, [(r"blk_.\d+", "BLK"), (IP, "IP"), (r"\d+", "NUM")])


def leading(col: str, k: int) -> str:
    return f"array_to_string({tokens(col)}[{k + 1}:], ' ')"


def stamp_text(col: str) -> str:
    """The line's time as text, microseconds in full."""
    return f"regexp_extract({col}, '{STAMP}')"


def preprocessed(src: str) -> list[tuple[str, str]]:
    """From ``src`` (line_id, line) to ``records`` (line_id, label, sentence)."""
    return [
        *mask_bgl(src),
        ("tagged", f"SELECT *, trim(t,{WS}) AS b, regexp_extract(trim(t,{WS}),'^\\S+') AS tag FROM masked"),
        ("plain", f"""SELECT *, CASE WHEN tag='-' THEN 0 ELSE 1 END AS label,
          {normalised("CASE WHEN tag='-' THEN b ELSE substr(b, length(tag)+1) END")} AS p FROM tagged"""),
        ("records", "SELECT line_id, line, label, array_to_string(string_split(p,' ')[4:],' ') AS sentence FROM plain"),
    ]


# --- splits and samples -------------------------------------------------------

RAW_LABELLED = (
    "labelled",
    f"SELECT *, CASE WHEN {tokens('line')}[1]='-' THEN 0 ELSE 1 END AS label FROM log_lines",
)
LINES = ("log_lines", LOG_LINES)


def split(seed: int = 1234, size: float = 0.2) -> list[tuple[str, str]]:
    return [
        LINES, RAW_LABELLED,
        ("ranked", f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key(seed, 'line_id')},
          line_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled"""),
        ("split", f"""SELECT line_id, line, label, CASE WHEN label=1 OR rn<=ceil(n*{size}::DOUBLE)
          THEN 'test' ELSE 'train' END AS split FROM ranked"""),
    ]


DOCS = ("docs", "SELECT doc_id, toxic AS label FROM documents LEFT JOIN labels USING (doc_id)")


def docs_ranked(seed: int) -> tuple[str, str]:
    return ("ranked", f"""SELECT *, {key(seed, 'doc_id')} AS k, row_number() OVER (PARTITION BY label
      ORDER BY {key(seed, 'doc_id')}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n,
      count(*) OVER () AS total, avg(label::DOUBLE) OVER () AS share FROM docs
      WHERE label IS NOT NULL""")


# --- vectors -------------------------------------------------------------------

HEX = "'0123456789abcdef'"


def hash_vectors(src: str) -> list[tuple[str, str]]:
    """From ``src`` (… sentence) to ``embedded`` (… tokens, first)."""
    byte = (
        f"(2*(16*(instr({HEX},substr(m,2*i-1,1))-1)+instr({HEX},substr(m,2*i,1))-1)-255)"
    )
    return [
        ("sums", f"""SELECT *, list_transform(list_transform(string_split(sentence,' '),
          lambda w: md5(w)), lambda m: list_transform(range(1,17), lambda i: {byte}))
          AS s FROM {src}"""),
        ("embedded", """SELECT * EXCLUDE (s), list_transform(range(1,17), lambda i:
          (list_sum(list_transform(s, lambda v: v[i]))::DOUBLE/(len(s)*255))::FLOAT::DOUBLE) AS first,
          list_transform(s, lambda v: list_transform(v, lambda x: (x/255::DOUBLE)::FLOAT::DOUBLE))
          AS words FROM sums"""),
    ]


def distances(bank: str = "bank", test: str = "test", vec: str = "first") -> str:
    return f"""SELECT t.vec_id AS test_id, b.vec_id AS bank_id,
      list_distance(t.{vec}, b.{vec}) AS d FROM {test} t, {bank} b"""


VEC_SIDES = [
    ("vec", VEC),
    ("bank", "SELECT * FROM vec WHERE in_bank"),
    ("test", "SELECT * FROM vec WHERE NOT in_bank"),
]


def sim(metric: str = "cos", only_first: bool = False) -> str:
    f = {"cos": "list_cosine_similarity", "dot": "list_inner_product"}[metric]
    a, b = ("[t.first]", "[b.first]") if only_first else ("t.tokens", "b.tokens")
    return f"""list_sum(list_transform({a}, lambda x: list_max(list_transform({b},
      lambda y: {f}(x, y)))))"""


def sims(**kw) -> str:
    return f"SELECT t.vec_id AS test_id, b.vec_id AS bank_id, {sim(**kw)} AS s FROM test t, bank b"


CORE = ("core", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id
  ORDER BY d, bank_id) AS rank FROM dist) WHERE rank <= 5""")


# --- curves and metrics -----------------------------------------------------------


def curve(src: str = "scored", extra: str = "") -> list[tuple[str, str]]:
    return [
        ("per_score", f"""SELECT {extra}score, sum(CASE WHEN label=1 THEN 1 ELSE 0 END)::BIGINT AS pos,
          sum(CASE WHEN label=0 THEN 1 ELSE 0 END)::BIGINT AS neg FROM {src} GROUP BY ALL"""),
        ("cum", f"""SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
          sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg FROM per_score
          WINDOW w AS ({'PARTITION BY ' + extra.rstrip(', ') if extra else ''} ORDER BY score DESC
            ROWS UNBOUNDED PRECEDING),
          a AS ({'PARTITION BY ' + extra.rstrip(', ') if extra else ''})"""),
    ]


PR = """SELECT {x}score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp,
  tp::DOUBLE/(tp+fp)::DOUBLE AS precision,
  CASE WHEN all_pos>0 THEN tp::DOUBLE/all_pos::DOUBLE ELSE 1.0::DOUBLE END AS recall FROM cum"""
BEST = """SELECT *, 2.0::DOUBLE*(precision*recall)/(precision+recall+1e-10::DOUBLE) AS f1 FROM pr"""
ROC = """SELECT score::DOUBLE AS threshold, fp::DOUBLE/all_neg::DOUBLE AS fpr,
  tp::DOUBLE/all_pos::DOUBLE AS tpr FROM cum UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""


def cells(pred: str, weight: str = "1") -> str:
    def one(y: int, p: int) -> str:
        return f"coalesce(sum(CASE WHEN label={y} AND {pred}={p} THEN {weight} END),0)::BIGINT"

    return f"{one(0,0)} AS tn, {one(0,1)} AS fp, {one(1,0)} AS fn, {one(1,1)} AS tp"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b})<>0 THEN ({a})::DOUBLE/({b})::DOUBLE ELSE 0.0::DOUBLE END"


RATES = {
    "accuracy": ratio("tn+tp", "tn+fp+fn+tp"),
    "precision": ratio("tp", "tp+fp"),
    "recall": ratio("tp", "tp+fn"),
    "f1": ratio("2*tp", "2*tp+fp+fn"),
    "false_positive_rate": ratio("fp", "fp+tn"),
    "false_negative_rate": ratio("fn", "fn+tp"),
    "hard_auc": f"CASE WHEN tp+fn>0 AND fp+tn>0 THEN ({ratio('tp','tp+fn')}+{ratio('tn','fp+tn')})/2 END",
}


def rates(digits: int, *names: str) -> str:
    return ", ".join(f"round({RATES[n]},{digits}) AS {n}" for n in names or RATES)


# --- prompts -----------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def zero_shot(style: str, col: str) -> str:
    s = prompts.STYLES[style]
    return f"{quoted(s.instructions + chr(10) * 2 + s.entry + ' ')}||{col}||{quoted(chr(10) + s.answer)}"


def few_shot(style: str, col: str, block: str) -> str:
    s = prompts.STYLES[style]
    head = f"{s.instructions}\n\n{s.examples_head}\n\n"
    tail = f"\n\n{s.final_head}\n\n{s.entry} "
    return f"{quoted(head)}||{block}||{quoted(tail)}||{col}||{quoted(chr(10) + s.answer)}"


FIELDS = [
    LINES,
    ("parts", f"SELECT line_id, trim(line,{WS}) AS raw_line, {tokens('line')} AS t FROM log_lines"),
    ("fields", """SELECT line_id, t[1] AS alert_tag, CASE WHEN t[1]='-' THEN 0 ELSE 1 END AS label,
      t[7] AS type, t[8] AS component, t[9] AS level, array_to_string(t[10:],' ') AS content, raw_line,
      'TYPE='||t[7]||' COMPONENT='||t[8]||' LEVEL='||t[9]||' CONTENT='||array_to_string(t[10:],' ')
      AS log_text FROM parts WHERE len(t)>=10"""),
]


def mix(a: int, n: int) -> str:
    return f"""SELECT line_id, log_text AS log, label FROM (SELECT *, row_number() OVER (PARTITION BY
      label ORDER BY line_id) AS rn FROM fields) WHERE (label=1 AND rn<={a}) OR (label=0 AND rn<={n})"""


def block(style: str) -> str:
    s = prompts.STYLES[style]
    one = f"{quoted(s.entry + ' ')}||log||{quoted(chr(10) + s.answer + ' ')}||label"
    return f"SELECT string_agg({one}, {quoted(chr(10) * 2)} ORDER BY label DESC, line_id) AS block FROM mix"


# fixed values: what an answer looks like
BARE = f"trim(regexp_replace(response,'(?s)<think>.*?</think>','','g'),{WS})"
ALONE = r"\b([01])\b"


def group(pattern: str) -> str:
    return f"nullif(regexp_extract({BARE},'{pattern}',1),'')"


STRICT = f"coalesce({group(ALONE)}::INT,-1)"
FIRST = f"coalesce({group(ALONE)},{group('([01])')},'0')::INT"
FALLBACK = f"CASE WHEN regexp_matches({BARE},'{ALONE}') THEN 0 ELSE 1 END"
LAST = f"coalesce({group('(?s)^.*' + ALONE)},{group('(?s)^.*([01])')},'0')"
OBJECT = """nullif(regexp_extract(response,'\\{[^{}]*"Label"[^{}]*\\}'),'')"""
ALARM = r"(?i)\b(" + "|".join(ALARM_WORDS) + r")\b"

CONFIGS = "SELECT * FROM (VALUES " + ", ".join(
    [f"('few_shot','{m}',{c})" for m in MIXES for c in CAPS["few_shot"]]
    + [f"('zero_shot','none',{c})" for c in CAPS["zero_shot"]]
) + ") v(mode, mix, cap)"

RUNS = """SELECT event_id AS line_id, mix, cap, CASE WHEN (event_id*7+cap+length(mix))%13<9 THEN '0'
  WHEN (event_id*7+cap+length(mix))%13<12 THEN '1' ELSE '?' END AS label_text,
  (event_id%97+cap)/4.0::DOUBLE AS ms FROM events, configs WHERE mode='few_shot'"""
STATS = """SELECT mix, cap, count(*) AS total_logs, sum(ms)/1000 AS time_taken_seconds,
  sum(CASE WHEN label_text='0' THEN 1 ELSE 0 END)::BIGINT AS normal_count,
  sum(CASE WHEN label_text='1' THEN 1 ELSE 0 END)::BIGINT AS abnormal_count FROM runs GROUP BY ALL"""
STATS_FULL = """SELECT mix, cap, total_logs, round(time_taken_seconds,6) AS time_taken_seconds,
  normal_count, abnormal_count, round(time_taken_seconds/total_logs*1000,6) AS avg_time_per_log_ms,
  round(total_logs/time_taken_seconds,6) AS throughput_logs_per_second,
  round(normal_count::DOUBLE/total_logs*100,6) AS normal_percentage,
  round(abnormal_count::DOUBLE/total_logs*100,6) AS abnormal_percentage FROM stats"""
RUN_CTES = [("configs", CONFIGS), ("runs", RUNS), ("stats", STATS), ("full_stats", STATS_FULL)]

SESSION_LABELS = """SELECT DISTINCT 'blk_'||(user_id+100) AS session_id,
  CASE WHEN (user_id+100)%7=0 THEN 1 ELSE 0 END AS label FROM events WHERE (user_id+100)%10<>3"""
SESSIONS = [
    LINES,
    ("sessions", """SELECT unnest(list_distinct(regexp_extract_all(line,'blk_-?[0-9]+'))) AS session_id,
      line_id, line FROM log_lines WHERE line LIKE '%blk\\_%' ESCAPE '\\'"""),
    ("slabels", SESSION_LABELS),
    ("content", f"SELECT *, {leading('line', 3)} AS c FROM sessions"),
    ("sparsed", f"""SELECT session_id, line_id, nullif(regexp_extract(c,'blk_.\\d+'),'') AS block_id,
      {normalised(hdfs('c'))} AS parsed FROM content"""),
]

SPLIT_COUNTS = [
    ("train", "SELECT DISTINCT r.sentence FROM records r JOIN split USING (line_id) WHERE split='train'"),
    ("test", """SELECT r.sentence, r.label, count(*) AS n FROM records r JOIN split USING (line_id)
      WHERE split='test' GROUP BY ALL"""),
]
DETECT = [
    *split(),
    *preprocessed("log_lines"),
    *SPLIT_COUNTS,
    ("all_sentences", "SELECT sentence FROM train UNION SELECT sentence FROM test"),
    *hash_vectors("all_sentences"),
    ("bank", "SELECT DISTINCT first FROM embedded SEMI JOIN train USING (sentence)"),
    ("asked", "SELECT sentence, first FROM embedded SEMI JOIN test USING (sentence)"),
    ("near", """SELECT t.sentence, round(min(list_distance(t.first,b.first)),6) AS score
      FROM asked t, bank b GROUP BY ALL"""),
]


def methods_report(
    parts: list[tuple[str, str]], names: tuple[str, ...], search: str = "prc", core: float = 0,
    novel: bool = False, first_only: bool = False,
) -> str:
    """From ``train`` (sentence) and ``test`` (sentence, label, n): a row of metrics per method.
    ``core`` compares with that share of the bank, the nearest; ``novel`` keeps templates
    whose first vector is not in the bank."""
    scores = {
        "knn": """SELECT 'knn' AS method, t.sentence, round(min(list_distance(t.first,b.first)),6) AS score
          FROM asked t, bank b GROUP BY ALL""",
        "maxsim_max": "SELECT 'maxsim_max' AS method, sentence, round((SELECT max(mx) FROM agg)-mx,6) AS score FROM agg",
        "maxsim_mean": "SELECT 'maxsim_mean' AS method, sentence, round((SELECT max(mn) FROM agg)-mn,6) AS score FROM agg",
    }
    pairs = [
        ("agg", f"""SELECT sentence, max(s) AS mx, avg(s) AS mn FROM (SELECT t.sentence, {sim(only_first=first_only)} AS s
          FROM asked t, bank b {"SEMI JOIN core c ON c.sentence = t.sentence AND c.other = b.sentence" if core else ""}) GROUP BY ALL"""),
    ]
    if core:
        pairs.insert(0, ("core", f"""SELECT t.sentence, b.sentence AS other FROM asked t, bank b QUALIFY row_number() OVER (
          PARTITION BY t.sentence ORDER BY list_distance(t.first,b.first), b.sentence)
          <= greatest(1, floor((SELECT count(*) FROM bank)*{core}::DOUBLE))"""))
    found = "first NOT IN (SELECT first FROM bank)" if novel else "true"
    cut = {
        "prc": [
            ("pr", PR.format(x="method, ")), ("best", BEST),
            ("cut", "SELECT * FROM (SELECT method, threshold, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, threshold) AS r FROM best) WHERE r=1"),
        ],
        "roc": [
            ("points", """SELECT method, score AS threshold, tp::DOUBLE/all_pos::DOUBLE - fp::DOUBLE/all_neg::DOUBLE AS j FROM cum
              UNION ALL SELECT DISTINCT method, 'inf'::DOUBLE, 0.0::DOUBLE FROM cum"""),
            ("cut", "SELECT * FROM (SELECT method, threshold, row_number() OVER (PARTITION BY method ORDER BY j DESC, threshold DESC) AS r FROM points) WHERE r=1"),
        ],
    }[search]
    return ctes(
        *parts,
        ("all_sentences", "SELECT sentence FROM train UNION SELECT sentence FROM test"),
        *hash_vectors("all_sentences"),
        ("vectors", "SELECT sentence, first, list_concat([first], words) AS tokens FROM embedded"),
        ("bank", "SELECT * FROM vectors SEMI JOIN train USING (sentence)"),
        ("asked", f"SELECT * FROM vectors SEMI JOIN test USING (sentence) WHERE {found}"),
        *(pairs if set(names) - {"knn"} else []),
        ("scores", " UNION ALL ".join(scores[n] for n in names)),
        ("weighted", "SELECT method, sentence, score, label, n FROM scores JOIN test USING (sentence)"),
        ("per_score", """SELECT method, score, coalesce(sum(CASE WHEN label=1 THEN n END),0)::BIGINT AS pos,
          coalesce(sum(CASE WHEN label=0 THEN n END),0)::BIGINT AS neg FROM weighted GROUP BY ALL"""),
        ("cum", """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS all_pos,
          sum(neg) OVER (PARTITION BY method) AS all_neg FROM per_score
          WINDOW w AS (PARTITION BY method ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""),
        *cut,
        ("judged", "SELECT w.*, CASE WHEN score>=threshold THEN 1 ELSE 0 END AS prediction FROM weighted w JOIN cut USING (method)"),
        ("c", f"SELECT method, {cells('prediction', 'n')} FROM judged GROUP BY ALL"),
    )


THUNDERBIRD_RECORDS = [
    ("log_lines", CLUSTER_LINES),
    *split()[1:],
    ("m", f"SELECT line_id, {THUNDERBIRD} AS t FROM (SELECT line_id, line FROM log_lines)"),
    ("p", f"SELECT *, t[1:2]='- ' AS normal, {normalised('CASE WHEN t[1:2]=chr(45)||chr(32) THEN t ELSE substr(t,strpos(t,chr(32))) END')} AS p FROM m"),
    ("records", "SELECT line_id, CASE WHEN normal THEN 0 ELSE 1 END AS label, array_to_string(string_split(p,' ')[4:],' ') AS sentence FROM p"),
    *SPLIT_COUNTS,
]

SESSION_RECORDS = [
    *SESSIONS,
    ("g", "SELECT session_id, list(DISTINCT parsed) AS l, arg_min(block_id, line_id) AS b FROM sparsed WHERE block_id IS NOT NULL GROUP BY session_id"),
    ("texts", """SELECT session_id AS line_id, label, CASE WHEN label=0 THEN '- ' ELSE '' END ||
      array_to_string(list_sort(list_distinct(list_append(l,b))),' ') AS line FROM g JOIN slabels USING (session_id)"""),
    ("ranked", f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key(1234, 'line_id')}, line_id) AS rn,
      count(*) OVER (PARTITION BY label) AS n FROM texts"""),
    ("split", "SELECT line_id, CASE WHEN label=1 OR rn<=ceil(n*0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ranked"),
    ("m", f"SELECT line_id, {hdfs(f'trim(line,{WS})')} AS t, nullif(regexp_extract(line,'blk_.\\d+'),'') AS s FROM texts"),
    ("p", f"SELECT *, {normalised('t')} AS p FROM m WHERE s IS NOT NULL"),
    ("records", "SELECT line_id, CASE WHEN regexp_extract(t,'^\\S+')='-' THEN 0 ELSE 1 END AS label, array_to_string(string_split(p,' ')[2:],' ') AS sentence FROM p"),
    *SPLIT_COUNTS,
]
