"""DuckDB SQL building blocks: the same tables and steps, written independently of the Spark operators."""

from palisade import fixed


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A constant table with a leading `prio` column."""
    body = ", ".join(
        f"({i}, " + ", ".join(text(v) if isinstance(v, str) or v is None else f"{v!r}::DOUBLE" for v in row) + ")"
        for i, row in enumerate(rows)
    )
    return f"SELECT * FROM (VALUES {body}) t(prio, {names})"


_LOGS = """
soc_logs AS (
 SELECT event_id AS log_id, k, ts, epoch_us(ts)/1e6 AS "timestamp",
  CASE event_type
   WHEN 'error' THEN 'failed_login'
   WHEN 'view' THEN 'port_scan'
   WHEN 'click' THEN CASE WHEN k<70 THEN 'ddos_attempt' ELSE 'brute_force_burst' END
   WHEN 'signup' THEN CASE WHEN k<70 THEN 'unauthorized_access' WHEN k<85 THEN 'privilege_audit'
                           ELSE 'remote_access_probe' END
   WHEN 'purchase' THEN CASE WHEN k<40 THEN 'malware_detected' WHEN k<80 THEN 'privilege_escalation'
                             WHEN k<90 THEN 'sql_injection_probe' WHEN k<95 THEN 'Malware_Beacon'
                             WHEN k<99 THEN 'heartbeat' END
  END AS event,
  CASE WHEN k<>7 THEN concat('10.0.', CAST(user_id%4 AS VARCHAR), '.', CAST(user_id%20 AS VARCHAR)) END AS ip,
  CASE WHEN k%10<>3 THEN concat('user_', CAST(user_id AS VARCHAR)) END AS "user",
  CASE WHEN k%2=1 THEN value*100 END AS flow_duration
 FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events) e
),
hist AS (
 SELECT *, coalesce(ip,'unknown') AS addr, coalesce(event,'unknown') AS ev,
  CASE WHEN event='failed_login' AND ip IS NOT NULL
       THEN CAST(sum(CASE WHEN event='failed_login' AND ip IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS flc,
  row_number() OVER w AS rn,
  coalesce(event,'unknown') AS e1,
  lag(coalesce(event,'unknown'),1) OVER w AS e2, lag(coalesce(event,'unknown'),2) OVER w AS e3,
  lag(coalesce(event,'unknown'),3) OVER w AS e4, lag(coalesce(event,'unknown'),4) OVER w AS e5,
  "timestamp" - lag("timestamp") OVER w AS gap
 FROM soc_logs
 WINDOW w AS (PARTITION BY coalesce(ip,'unknown') ORDER BY "timestamp", log_id)
),
islands AS (
 SELECT *, sum(CASE WHEN gap IS NULL OR gap>3600 THEN 1 ELSE 0 END)
           OVER (PARTITION BY addr ORDER BY "timestamp", log_id) AS island
 FROM hist
),
freq AS (
 SELECT *, row_number() OVER (PARTITION BY addr, island ORDER BY "timestamp", log_id) AS attack_frequency FROM islands
),
det AS (
 SELECT *, CASE WHEN flc>5 THEN 'HIGH'
                WHEN ev IN ('malware_detected','privilege_escalation','unauthorized_access') THEN 'HIGH'
                WHEN ev IN ('port_scan','ddos_attempt') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  least(rn,5) AS n_recent
 FROM freq
),
trans AS (
 SELECT length, context, next_event, count(*) AS n FROM (
  SELECT 0 AS length, '' AS context, e1 AS next_event FROM hist
  UNION ALL SELECT 1, e2, e1 FROM hist WHERE rn>1
  UNION ALL SELECT 2, concat(e3,'>',e2), e1 FROM hist WHERE rn>2) t GROUP BY ALL
),
prob AS (
 SELECT *, n/support AS probability FROM (
  SELECT *, sum(n) OVER (PARTITION BY length, context)::BIGINT AS support,
   row_number() OVER (PARTITION BY length, context ORDER BY n DESC, next_event) AS place FROM trans) t
),
best AS (SELECT * FROM prob WHERE place=1 AND support>=5),
pred AS (
 SELECT d.*, coalesce(b2.next_event, b1.next_event, b0.next_event) AS predicted_next_attack,
  CASE WHEN b2.next_event IS NOT NULL THEN b2.probability WHEN b1.next_event IS NOT NULL THEN b1.probability
       ELSE b0.probability END AS probability,
  CASE WHEN b2.next_event IS NOT NULL THEN 2 WHEN b1.next_event IS NOT NULL THEN 1
       WHEN b0.next_event IS NOT NULL THEN 0 END AS context_length
 FROM det d
 LEFT JOIN best b2 ON b2.length=2 AND d.rn>=2 AND b2.context=concat(d.e2,'>',d.e1)
 LEFT JOIN best b1 ON b1.length=1 AND b1.context=d.e1
 LEFT JOIN best b0 ON b0.length=0
),
"""

_KB = f"""
techniques AS ({values(fixed.TECHNIQUES, "name, technique, tactic, confidence, action")}),
keywords AS ({values(fixed.KEYWORD_TECHNIQUES, "keyword, technique, tactic, confidence, action")}),
contexts AS ({values(fixed.ATTACK_CONTEXT, "name, sentence")}),
codes AS (SELECT name, CAST(code AS INT) AS code FROM ({values(fixed.LABEL_CODES, "name, code")}) c),
flow_defaults AS ({values([(e, *map(float, v)) for e, v in fixed.EVENT_FLOW_DEFAULTS], "event, f1, f2, f3, f4, f5, f6, f7, f8, f9, f10")}),
vectors AS ({values([(e, *map(float, v)) for e, v in fixed.EVENT_VECTORS], "event, v1, v2, v3, v4, v5, v6")}),
first_keyword AS (
 SELECT ev AS kev, min(prio) AS prio FROM (SELECT DISTINCT ev FROM det) d JOIN keywords ON contains(lower(ev), keyword) GROUP BY ev
),
"""


def context_of(attack: str) -> str:
    return (
        f"coalesce((SELECT sentence FROM contexts c WHERE c.name={attack}), "
        f"(SELECT arg_min(sentence, prio) FROM contexts c WHERE contains(lower({attack}), lower(c.name))), "
        f"concat('Unknown attack pattern predicted: ''', {attack}, ''' — manual analyst review required.'))"
    )


def pct(share: str) -> str:
    """A share as percent with one decimal."""
    t = f"CAST(floor({share}*100*10+0.5) AS BIGINT)"
    return f"concat(CAST({t}//10 AS VARCHAR), '.', CAST({t}%10 AS VARCHAR))"


RULE_TEXT = """CASE WHEN severity IN ('HIGH','CRITICAL') THEN concat('High-severity event ''', ev, ''' detected — immediate analyst review required.')
 WHEN severity='MEDIUM' THEN concat('Suspicious activity ''', ev, ''' — monitor for escalation.')
 ELSE concat('Low-risk event ''', ev, ''' — logged for audit trail.') END"""

_CHAIN = f"""
ctx AS (SELECT a AS attack, {context_of("a")} AS sentence FROM (SELECT DISTINCT predicted_next_attack AS a FROM pred) p),
inv AS (
 SELECT p.*, round(probability,4) AS confidence,
  concat(ctx.sentence, ' (N-gram model predicted ''', predicted_next_attack, ''' with ', {pct("probability")},
   '% confidence based on last ', CAST(n_recent AS VARCHAR), ' events from ', addr, '.)') AS investigation
 FROM pred p LEFT JOIN ctx ON ctx.attack=p.predicted_next_attack
),
enr AS (
 SELECT i.*,
  CASE WHEN t.name IS NOT NULL THEN t.technique WHEN p.name IS NOT NULL THEN p.technique
       WHEN k.prio IS NOT NULL THEN k.technique ELSE {text(fixed.UNKNOWN_TECHNIQUE[0])} END AS mitre_attack,
  CASE WHEN t.name IS NOT NULL THEN t.tactic WHEN p.name IS NOT NULL THEN p.tactic
       WHEN k.prio IS NOT NULL THEN k.tactic ELSE {text(fixed.UNKNOWN_TECHNIQUE[1])} END AS mitre_tactic,
  CASE WHEN t.name IS NOT NULL THEN t.confidence WHEN p.name IS NOT NULL THEN round(p.confidence*0.85,2)
       WHEN k.prio IS NOT NULL THEN k.confidence ELSE 0.3 END AS mitre_confidence,
  CASE WHEN t.name IS NOT NULL THEN t.action WHEN p.name IS NOT NULL THEN p.action
       WHEN k.prio IS NOT NULL THEN k.action ELSE {text(fixed.UNKNOWN_TECHNIQUE[3])} END AS recommended_action,
  CASE WHEN t.name IS NOT NULL THEN 'exact_match'
       WHEN p.name IS NOT NULL THEN concat('Mapped via LSTM-predicted attack: ', i.predicted_next_attack)
       WHEN k.prio IS NOT NULL THEN concat('Fuzzy-matched on keyword ''', k.keyword, ''' — confidence reduced.')
       ELSE 'exact_match' END AS threat_intel_method,
  CASE WHEN t.name IS NOT NULL THEN 'exact' WHEN p.name IS NOT NULL THEN 'predicted'
       WHEN k.prio IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS match_kind
 FROM inv i LEFT JOIN techniques t ON t.name=i.ev LEFT JOIN techniques p ON p.name=i.predicted_next_attack
 LEFT JOIN first_keyword f ON f.kev=i.ev LEFT JOIN keywords k ON k.prio=f.prio
),
rule_enr AS (
 SELECT d.*, {RULE_TEXT} AS investigation,
  CASE WHEN t.name IS NOT NULL THEN t.technique WHEN k.prio IS NOT NULL THEN k.technique
       ELSE {text(fixed.UNKNOWN_TECHNIQUE[0])} END AS mitre_attack,
  CASE WHEN t.name IS NOT NULL THEN t.tactic WHEN k.prio IS NOT NULL THEN k.tactic
       ELSE {text(fixed.UNKNOWN_TECHNIQUE[1])} END AS mitre_tactic,
  CASE WHEN t.name IS NOT NULL THEN t.confidence WHEN k.prio IS NOT NULL THEN k.confidence ELSE 0.3 END AS mitre_confidence,
  CASE WHEN t.name IS NOT NULL THEN t.action WHEN k.prio IS NOT NULL THEN k.action
       ELSE {text(fixed.UNKNOWN_TECHNIQUE[3])} END AS recommended_action
 FROM det d LEFT JOIN techniques t ON t.name=d.ev
 LEFT JOIN first_keyword f ON f.kev=d.ev LEFT JOIN keywords k ON k.prio=f.prio
),
acts AS (
 SELECT log_id, severity, 0 AS action_no, 'BLOCK_IP' AS action, addr AS target,
  concat('iptables -A INPUT -s ', addr, ' -j DROP') AS command, NULL AS event, 'simulated' AS status,
  {text(fixed.RESPONSES["BLOCK_IP"][2])} AS note FROM det WHERE severity='HIGH'
 UNION ALL SELECT log_id, severity, 1, 'FLAG_USER_FOR_REVIEW', "user", NULL, NULL, 'logged',
  {text(fixed.RESPONSES["FLAG_USER_FOR_REVIEW"][2])} FROM det WHERE severity='HIGH' AND "user" IS NOT NULL
 UNION ALL SELECT log_id, severity, 0, 'RATE_LIMIT_IP', addr,
  concat('iptables -A INPUT -s ', addr, ' -m hashlimit --hashlimit-above 10/min --hashlimit-mode srcip -j DROP'),
  NULL, 'simulated', {text(fixed.RESPONSES["RATE_LIMIT_IP"][2])} FROM det WHERE severity='MEDIUM'
 UNION ALL SELECT log_id, severity, 1, 'INCREASE_MONITORING', addr, NULL, NULL, 'logged',
  {text(fixed.RESPONSES["INCREASE_MONITORING"][2])} FROM det WHERE severity='MEDIUM'
 UNION ALL SELECT log_id, severity, 0, 'AUDIT_LOG', addr, NULL, ev, 'logged',
  {text(fixed.RESPONSES["AUDIT_LOG"][2])} FROM det WHERE severity='LOW'
)
"""


def logs(select: str, more: str = "") -> str:
    """A SELECT over the log tables; `more` adds tables of its own."""
    return f"WITH {_LOGS.strip()} {_KB.strip()} {_CHAIN.strip()} {', ' + more if more else ''} {select}"


_FEATURES = ", ".join(f'"{c}"' for c in fixed.FLOW_FEATURES)

_FLOWS = """
flows AS (
 SELECT l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS ship_day,
  md5(concat_ws('|', CAST(l_shipdate AS VARCHAR), l_orderkey, l_partkey, l_suppkey, l_linenumber, '42')) AS row_hash,
  l_suppkey%8 AS file_id,
  l_extendedprice AS "Flow Duration", l_quantity AS "Total Fwd Packets",
  CAST(l_linenumber AS DOUBLE) AS "Total Backward Packets",
  CASE WHEN l_partkey%50=1 THEN NULL WHEN l_discount=0 THEN 'Infinity'::DOUBLE
       ELSE l_extendedprice/l_discount END AS "Flow Bytes/s",
  CASE WHEN l_tax=0 THEN 'Infinity'::DOUBLE ELSE l_quantity/l_tax END AS "Flow Packets/s",
  l_extendedprice/l_quantity AS "Fwd Packet Length Mean", l_extendedprice/l_linenumber AS "Bwd Packet Length Mean",
  CAST(l_linenumber%2 AS DOUBLE) AS "SYN Flag Count",
  CASE WHEN l_returnflag='A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "ACK Flag Count",
  l_extendedprice/(l_quantity+l_linenumber) AS "Average Packet Size",
  CASE l_partkey%40 WHEN 25 THEN ' BENIGN ' WHEN 26 THEN 'Bot' WHEN 27 THEN 'DDoS' WHEN 28 THEN 'DoS GoldenEye'
   WHEN 29 THEN 'DoS Hulk' WHEN 30 THEN 'DoS Slowhttptest' WHEN 31 THEN 'DoS slowloris' WHEN 32 THEN 'FTP-Patator'
   WHEN 33 THEN 'Heartbleed' WHEN 34 THEN 'Infiltration' WHEN 35 THEN 'PortScan' WHEN 36 THEN 'SSH-Patator'
   WHEN 37 THEN 'Web Attack - Brute Force' WHEN 38 THEN 'Web Attack - XSS' WHEN 39 THEN NULL ELSE 'BENIGN' END AS "Label"
 FROM lineitem
),
"""


def near(value: str, digits: int) -> str:
    """Rounding by plain arithmetic, the same in both engines also on ties."""
    return f"floor({value}*1e{digits}+0.5::DOUBLE)/1e{digits}"


def _no_infinity(column: str) -> str:
    return f"CASE WHEN isinf(\"{column}\") THEN NULL ELSE \"{column}\" END AS \"{column}\""


def _zero_infinity(column: str) -> str:
    return f"CASE WHEN isinf(\"{column}\") THEN 0 ELSE \"{column}\" END AS \"{column}\""


KEY = "l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber"
SHOWN_KEY = "ship_day, l_orderkey, l_partkey, l_suppkey, l_linenumber"


def severity_of(label: str, critical: list[str]) -> str:
    tests = " OR ".join(f"contains({label}, '{w}')" for w in critical)
    return (
        f"CASE WHEN {label}='BENIGN' THEN 'LOW' WHEN contains({label},'PortScan') THEN 'MEDIUM' "
        f"WHEN contains({label},'Brute Force') OR contains({label},'Web Attack') OR contains({label},'Infiltration') "
        f"THEN 'HIGH' WHEN {tests} THEN 'CRITICAL' ELSE 'MEDIUM' END"
    )


BASIC = severity_of('trim("Label")', ["DDoS", "Bot"])
RICH = severity_of('trim("Label")', ["DDoS", "DoS", "Bot", "Heartbleed"])

_PREP = f"""
nulled AS (SELECT * REPLACE ({", ".join(_no_infinity(c) for c in fixed.FLOW_FEATURES)}) FROM flows),
labelled AS (SELECT * FROM nulled WHERE "Label" IS NOT NULL),
mapping AS (SELECT "Label" AS class, CAST(row_number() OVER (ORDER BY "Label")-1 AS INT) AS code
            FROM (SELECT DISTINCT "Label" FROM labelled) t),
zeroed AS (
 SELECT * REPLACE ({", ".join(_zero_infinity(c) for c in fixed.FLOW_FEATURES)}) FROM flows
),
seq_rows AS (
 SELECT * REPLACE (trim("Label") AS "Label") FROM zeroed
 WHERE "Label" IS NOT NULL AND "Flow Packets/s" IS NOT NULL AND "Flow Bytes/s" IS NOT NULL
),
seq_codes AS (SELECT "Label" AS class, CAST(row_number() OVER (ORDER BY "Label")-1 AS INT) AS code
              FROM (SELECT DISTINCT "Label" FROM seq_rows) t),
encoded AS (
 SELECT r.*, c.code AS attack_encoded,
  CASE {RICH} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS severity_encoded,
  "Flow Packets/s"/((SELECT max("Flow Packets/s") FROM seq_rows)+1) AS anomaly_score,
  row_number() OVER (PARTITION BY "Label" ORDER BY {KEY})-1 AS attack_frequency
 FROM seq_rows r JOIN seq_codes c ON c.class=r."Label"
),
texts AS (
 SELECT *, concat_ws(',', attack_encoded, severity_encoded, CAST(floor(anomaly_score*1000000+0.5) AS BIGINT),
  CAST(floor("Flow Packets/s"*100+0.5) AS BIGINT), attack_frequency, CASE WHEN attack_frequency>3 THEN 1 ELSE 0 END) AS v
 FROM encoded
),
splits AS (
 SELECT *, CASE WHEN row_number() OVER (PARTITION BY "Label" ORDER BY row_hash, {KEY})
                     <= ceil(count(*) OVER (PARTITION BY "Label")*0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part
 FROM flows WHERE "Label" IS NOT NULL
)
"""


def flows(select: str) -> str:
    """A SELECT over the flow tables."""
    return f"WITH {_FLOWS.strip()} {_PREP.strip()} {select}"


def windows(partition: str) -> str:
    """Sequence windows over `texts`, with the given PARTITION BY clause."""
    lags = ", ".join(f"lag(v,{i}) OVER w AS p{i}" for i in range(1, 6))
    return f"""SELECT {SHOWN_KEY}, y, md5(concat_ws(';',p5,p4,p3,p2,p1)) AS seq_md5 FROM (
 SELECT *, {lags}, attack_encoded AS y, row_number() OVER w AS rn FROM texts
 WINDOW w AS ({partition} ORDER BY {KEY})) t WHERE rn>5"""
