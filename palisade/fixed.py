"""Fixed values.

The tables below are plain data: names, codes, thresholds and texts that results have to agree on. Nothing here is
logic; the operators read them.
"""

# --- severities -------------------------------------------------------------------------------------------------------

SEVERITY_CODES = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}

HIGH_EVENTS = ["malware_detected", "privilege_escalation", "unauthorized_access"]
MEDIUM_EVENTS = ["port_scan", "ddos_attempt"]

FAILED_LOGIN = "failed_login"
FAILED_LOGIN_LIMIT = 5
ANOMALY_HIGH_BELOW = -0.15

# Label keyword rules: (keywords, severity), first rule with a keyword inside the label wins; otherwise MEDIUM.
SEVERITY_RULES = {
    "basic": [
        (["PortScan"], "MEDIUM"),
        (["Brute Force", "Web Attack", "Infiltration"], "HIGH"),
        (["DDoS", "Bot"], "CRITICAL"),
    ],
    "rich": [
        (["PortScan"], "MEDIUM"),
        (["Brute Force", "Web Attack", "Infiltration"], "HIGH"),
        (["DDoS", "DoS", "Bot", "Heartbleed"], "CRITICAL"),
    ],
}

# --- flow features ----------------------------------------------------------------------------------------------------

FLOW_FEATURES = [
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Mean",
    "SYN Flag Count",
    "ACK Flag Count",
    "Average Packet Size",
]

# Per event, one value for each entry of FLOW_FEATURES.
EVENT_FLOW_DEFAULTS = [
    ("malware_detected", [5000, 50, 200, 900000, 50, 1200, 800, 5, 40, 900]),
    ("privilege_escalation", [3000, 30, 150, 700000, 40, 1000, 600, 4, 35, 800]),
    ("unauthorized_access", [4000, 40, 180, 850000, 45, 1100, 700, 5, 38, 850]),
    ("port_scan", [1000, 200, 10, 500000, 80, 100, 50, 2, 10, 120]),
    ("ddos_attempt", [8000, 500, 50, 999999, 99, 200, 100, 8, 60, 300]),
    ("failed_login", [500, 10, 5, 100000, 20, 400, 300, 1, 15, 380]),
    ("unknown", [200, 5, 3, 50000, 10, 300, 200, 0, 10, 280]),
]

SEVERITY_SET_FEATURES = [
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Flow Bytes/s",
    "Flow Packets/s",
]

# --- sequence features ------------------------------------------------------------------------------------------------

SEQUENCE_LENGTH = 5
SEQUENCE_FEATURES = [
    "attack_encoded",
    "severity_encoded",
    "anomaly_score",
    "packet_rate",
    "attack_frequency",
    "repeated_ip",
]

# Per event, one value for each entry of SEQUENCE_FEATURES.
EVENT_VECTORS = [
    ("malware_detected", [4, 2, 0.80, 8000, 5, 1]),
    ("privilege_escalation", [5, 2, 0.85, 7000, 4, 1]),
    ("unauthorized_access", [6, 2, 0.75, 6000, 3, 0]),
    ("port_scan", [2, 1, 0.40, 9000, 10, 0]),
    ("ddos_attempt", [1, 3, 0.95, 15000, 8, 1]),
    ("failed_login", [0, 0, 0.20, 2000, 2, 0]),
    ("unknown", [0, 0, 0.10, 500, 0, 0]),
]

FREQUENCY_TTL_SECONDS = 3600
OFFENDER_ABOVE = 3

LABEL_CODES = [
    ("BENIGN", 0),
    ("Bot", 1),
    ("DDoS", 2),
    ("DoS GoldenEye", 3),
    ("DoS Hulk", 4),
    ("DoS Slowhttptest", 5),
    ("DoS slowloris", 6),
    ("FTP-Patator", 7),
    ("Heartbleed", 8),
    ("Infiltration", 9),
    ("PortScan", 10),
    ("SSH-Patator", 11),
    ("Web Attack � Brute Force", 12),
    ("Web Attack � Sql Injection", 13),
    ("Web Attack � XSS", 14),
]

# --- attack context ---------------------------------------------------------------------------------------------------

# (attack name, sentence); the order decides which partial match wins.
ATTACK_CONTEXT = [
    ("BENIGN", "No malicious pattern detected in recent sequence."),
    ("DDoS", "DDoS attack pattern predicted — initiate traffic rate-limiting immediately."),
    ("PortScan", "Port scanning behaviour detected — potential reconnaissance in progress."),
    ("Bot", "Bot activity predicted — host may be part of a botnet."),
    ("Infiltration", "Infiltration sequence detected — lateral movement may be underway."),
    ("Web Attack � Brute Force", "Brute force sequence detected — consider account lockout and IP block."),
    ("Web Attack � XSS", "XSS attack sequence predicted — review web application firewall rules."),
    ("Web Attack � Sql Injection", "SQL injection sequence detected — database integrity at risk."),
    ("FTP-Patator", "FTP brute force predicted — restrict FTP access and rotate credentials."),
    ("SSH-Patator", "SSH brute force predicted — enforce key-based auth and block IP."),
    ("DoS slowloris", "Slowloris DoS predicted — connection timeout tuning recommended."),
    ("DoS Slowhttptest", "Slow HTTP DoS predicted — review server request timeout settings."),
    ("DoS Hulk", "Hulk DoS attack predicted — high-volume flood imminent."),
    ("DoS GoldenEye", "GoldenEye DoS predicted — application-layer flood likely."),
    ("Heartbleed", "Heartbleed exploit sequence detected — patch OpenSSL immediately."),
]
UNKNOWN_CONTEXT = "Unknown attack pattern predicted: '%s' — manual analyst review required."

RULE_INVESTIGATION = {
    "HIGH": "High-severity event '%s' detected — immediate analyst review required.",
    "MEDIUM": "Suspicious activity '%s' — monitor for escalation.",
    "LOW": "Low-risk event '%s' — logged for audit trail.",
}

# --- threat techniques ------------------------------------------------------------------------------------------------

# (event or attack name, technique, tactic, confidence, recommended action)
TECHNIQUES = [
    ("failed_login", "T1110 – Brute Force", "Credential Access", 0.95,
     "Enforce account lockout policy; block source IP after threshold."),
    ("Web Attack – Brute Force", "T1110.001 – Password Guessing", "Credential Access", 0.95,
     "Rate-limit login endpoints; enable MFA."),
    ("FTP-Patator", "T1110.001 – Password Guessing (FTP)", "Credential Access", 0.92,
     "Disable anonymous FTP; enforce key-based authentication."),
    ("SSH-Patator", "T1110.001 – Password Guessing (SSH)", "Credential Access", 0.92,
     "Switch to SSH key-based auth; block offending IPs via fail2ban."),
    ("port_scan", "T1046 – Network Service Discovery", "Discovery", 0.93,
     "Block scanning IP at perimeter firewall; alert SOC analyst."),
    ("malware_detected", "T1204 – User Execution", "Execution", 0.90,
     "Isolate affected host; run full AV scan; preserve forensic image."),
    ("privilege_escalation", "T1068 – Exploitation for Privilege Escalation", "Privilege Escalation", 0.91,
     "Revoke elevated session; patch vulnerable service; audit sudo logs."),
    ("unauthorized_access", "T1078 – Valid Accounts (Compromised)", "Initial Access", 0.88,
     "Force password reset for affected account; review access logs."),
    ("ddos_attempt", "T1498 – Network Denial of Service", "Impact", 0.94,
     "Activate DDoS mitigation; enable rate limiting; notify upstream ISP."),
    ("DDoS", "T1498 – Network Denial of Service", "Impact", 0.94,
     "Activate DDoS mitigation; enable rate limiting; notify upstream ISP."),
    ("DoS slowloris", "T1499.001 – OS Exhaustion Flood", "Impact", 0.90,
     "Tune server connection timeouts; deploy reverse proxy with request limits."),
    ("DoS Slowhttptest", "T1499.001 – OS Exhaustion Flood", "Impact", 0.90,
     "Tune server connection timeouts; deploy reverse proxy with request limits."),
    ("DoS Hulk", "T1499.002 – Service Exhaustion Flood", "Impact", 0.91,
     "Enable connection throttling; scale horizontally; block offending IPs."),
    ("DoS GoldenEye", "T1499.002 – Service Exhaustion Flood", "Impact", 0.91,
     "Enable connection throttling; scale horizontally; block offending IPs."),
    ("Bot", "T1071 – Application Layer Protocol (C2)", "Command and Control", 0.87,
     "Isolate host; investigate outbound connections; check for C2 beaconing."),
    ("Infiltration", "T1570 – Lateral Tool Transfer", "Lateral Movement", 0.86,
     "Segment network; revoke cross-host credentials; audit SMB/RDP logs."),
    ("Web Attack – XSS", "T1059.007 – JavaScript Injection", "Execution", 0.89,
     "Sanitise user input; enforce Content Security Policy headers."),
    ("Web Attack – SQL Injection", "T1190 – Exploit Public-Facing Application", "Initial Access", 0.93,
     "Parameterise all DB queries; review WAF rules; audit DB access logs."),
    ("Heartbleed", "T1190 – Exploit Public-Facing Application (CVE-2014-0160)", "Initial Access", 0.97,
     "Patch OpenSSL immediately; rotate all TLS certificates and session keys."),
    ("PortScan", "T1046 – Network Service Discovery", "Discovery", 0.93,
     "Block scanning IP at perimeter firewall; alert SOC analyst."),
]

# (keyword, technique, tactic, confidence, recommended action); the first keyword found in the event name wins.
KEYWORD_TECHNIQUES = [
    ("brute", "T1110 – Brute Force", "Credential Access", 0.60, "Enforce account lockout and MFA."),
    ("scan", "T1046 – Network Service Discovery", "Discovery", 0.60, "Block scanning IP at firewall."),
    ("dos", "T1498 – Network Denial of Service", "Impact", 0.60, "Activate DDoS mitigation controls."),
    ("ddos", "T1498 – Network Denial of Service", "Impact", 0.65, "Activate DDoS mitigation controls."),
    ("inject", "T1190 – Exploit Public-Facing App", "Initial Access", 0.58, "Review WAF and sanitise inputs."),
    ("malware", "T1204 – User Execution", "Execution", 0.65, "Isolate host and run AV scan."),
    ("privilege", "T1068 – Exploitation for Priv. Esc.", "Privilege Escalation", 0.62,
     "Revoke elevated session immediately."),
    ("login", "T1110 – Brute Force", "Credential Access", 0.55, "Review auth logs; enforce lockout."),
    ("access", "T1078 – Valid Accounts", "Initial Access", 0.50, "Audit account activity."),
]

UNKNOWN_TECHNIQUE = ("T0000 – Unclassified Technique", "Unknown", 0.30,
                     "Manual analyst review required — no matching MITRE technique found.")

PREDICTED_DISCOUNT = 0.85
PREDICTED_NOTE = "Mapped via LSTM-predicted attack: %s"
KEYWORD_NOTE = "Fuzzy-matched on keyword '%s' — confidence reduced."
EXACT_NOTE = "exact_match"

# --- response actions -------------------------------------------------------------------------------------------------

# action -> (command template or None, status, note); %s stands for the target.
RESPONSES = {
    "BLOCK_IP": ("iptables -A INPUT -s %s -j DROP", "simulated",
                 "iptables rule simulated — replace with real firewall API call."),
    "RATE_LIMIT_IP": ("iptables -A INPUT -s %s -m hashlimit --hashlimit-above 10/min --hashlimit-mode srcip -j DROP",
                      "simulated", "Rate-limit rule simulated."),
    "ISOLATE_USER": ("usermod --lock %s", "simulated",
                     "User lock simulated — replace with AD/LDAP disable call."),
    "FLAG_USER_FOR_REVIEW": (None, "logged", "User flagged in SOC dashboard for analyst review."),
    "INCREASE_MONITORING": (None, "logged", "Elevated monitoring window opened for this IP."),
    "AUDIT_LOG": (None, "logged", "Low-risk event recorded for audit trail."),
    "ESCALATE_TO_ANALYST": (None, "triggered", "CRITICAL alert for '%s' — paging on-call analyst."),
}
