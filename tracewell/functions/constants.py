"""Fixed values of the data model: word lists, lookup tables, thresholds and formats."""

# --- audit predicates (fixed values) ---
RBAC_RESOURCES = ["clusterroles", "clusterrolebindings", "roles", "rolebindings"]
SELF_REVIEW_RESOURCES = ["selfsubjectaccessreviews", "selfsubjectrulesreviews"]
WORKLOAD_RESOURCES = [
    "deployments", "daemonsets", "replicasets", "statefulsets",
    "jobs", "cronjobs", "pods", "replicationcontrollers",
]
CLUSTER_BINDING_RESOURCES = ["clusterrolebindings", "clusterroles"]
READ_VERBS = ["get", "list", "watch"]
RBAC_WRITE_VERBS = ["create", "update", "patch", "delete"]
WINDOW_EVENTS = 20
DECISION_KEY = "authorization.k8s.io/decision"

# --- feature order of the window table (fixed values) ---
COUNT_FEATURES = [
    "forbid_ratio", "n_forbid", "n_events", "n_distinct_resource", "n_distinct_verb",
    "n_distinct_ns", "n_secrets", "n_exec", "n_rbac", "n_create", "n_delete", "n_list",
    "n_4xx", "n_selfreview", "selfreview_ratio",
]
SIGNAL_FEATURES = [
    "has_secret", "has_exec", "has_rbac_write", "has_crb", "has_forbid", "secret_rate",
    "rbac_rate", "create_rate", "secret_ns", "severity", "cum_secrets", "cum_rbac_w",
    "cum_exec", "cum_crb", "has_impersonation", "n_distinct_impersonated",
    "n_create_workload", "has_csr", "has_tokenreq",
]
ALL_FEATURES = COUNT_FEATURES + SIGNAL_FEATURES
# The evaluated model leaves out four features, the production model two.
EVAL_FEATURES = [c for c in ALL_FEATURES
                 if c not in ("n_list", "n_create_workload", "has_csr", "has_tokenreq")]
PRODUCTION_FEATURES = [c for c in ALL_FEATURES if c not in ("n_list", "n_create_workload")]

# --- ordered substring -> tool rules (fixed values, order matters) ---
TOOL_RULES = [
    (["redteam-stratus", "stratus-red-team"], "stratus"),
    (["redteam-rakkess"], "rakkess"),
    (["redteam-peirates", "peirates"], "peirates"),
    (["adversary-stealth"], "lowslow"),
    (["adversary-creddump"], "credsyn"),
    (["adversary-persistsyn"], "persistsyn"),
    (["adversary-imp"], "impact"),
    (["adversary-eva"], "evasion"),
    (["adversary-lat"], "lateral"),
    (["redteam-persist"], "persistence"),
    (["redteam-lat-ext"], "lateralext"),
    (["adversary-escv"], "escv"),
    (["compromised-ctrl"], "compromised"),
]
DEFAULT_TOOL = "synthetic"
ATTACK_TOOLS = [
    "stratus", "rakkess", "peirates", "lowslow", "impact", "evasion", "lateral",
    "persistence", "lateralext", "escv", "compromised", "credsyn", "persistsyn",
]
SYNTHETIC_ATTACK_KEYS = ["victim-sa", "adversary-external", "adversary-insider", "recon-sa"]
RECON_KEYS = ["recon-sa", "redteam-rakkess"]

# --- allowlist: exact names and anchored prefixes (fixed values) ---
ALLOW_EXACT = [
    "ci-deployer", "sre-oncall", "devops-pipeline", "platform-engineer", "security-auditor",
    "platform-admin", "aksService", "readinessChecker", "masterclient", "hcpService",
    "system:apiserver", "system:serviceaccount:default:compliance-scanner-sa",
]
ALLOW_PREFIX = [
    "system:serviceaccount:kube-system:", "system:serviceaccount:monitoring:",
    "system:serviceaccount:cert-manager:", "system:serviceaccount:argocd:", "system:node:",
    "system:serviceaccount:falco:",
]

# --- train / held-out identities per tool (fixed values) ---
TRAIN_IDENTITIES = {
    "lateral": ["adversary-lateral", "adversary-lat-1", "adversary-lat-2"],
    "impact": ["adversary-impv-1", "adversary-impv-2", "adversary-impv-3"],
    "escv": ["adversary-escv-1", "adversary-escv-2", "adversary-escv-3"],
    "evasion": ["adversary-evav-1", "adversary-evav-2", "adversary-evav-3"],
}
OUT_OF_SCOPE_TOOLS = ["impact", "evasion", "compromised", "lowslow", "rakkess"]
HELD_OUT_PARTS = [
    "stratus_eval", "peirates_eval", "lowslow_eval", "lateral_eval", "impact_eval",
    "evasion_eval", "recon_eval", "persistence_eval", "lateralext_eval", "escv_eval",
]
PART_CATEGORY = {
    "stratus_eval": "HELD-ext escalation, sparse (Stratus)",
    "peirates_eval": "HELD-ext escalation, dense (Peirates)",
    "lowslow_eval": "HELD escalation, paced out (lowslow)",
    "lateral_eval": "HELD-id lateral (impersonation)",
    "impact_eval": "HELD-id impact (deletion)",
    "evasion_eval": "HELD-id defense evasion",
    "recon_eval": "HELD recon (rakkess)",
    "persistence_eval": "HELD-ext persistence (Stratus)",
    "lateralext_eval": "HELD-ext lateral token (Stratus)",
    "escv_eval": "HELD-id escalation, varied (synth)",
    "compromised_eval": "HELD kube-system compromised (allowlisted)",
}
TACTIC_OF_PART = {
    "escv_eval": "Privilege Escalation",
    "lateral_eval": "Lateral Movement",
    "credsyn_eval": "Credential Access",
    "persistsyn_eval": "Persistence",
    "peirates_eval": "Priv-Esc (Peirates, external)",
    "stratus_eval": "Cred-Access (Stratus, external)",
    "lateralext_eval": "Lateral (Stratus, external)",
    "persistence_eval": "Persistence (Stratus, external)",
    "recon_eval": "Recon (rakkess)",
}

# --- identity -> profile rules (fixed values, order matters) ---
PROFILE_CONTAINS = [("victim-sa", "stolen-token"), ("recon-sa", "recon")]
PROFILE_EQUALS = [("adversary-external", "valid-abuse"), ("adversary-insider", "low-and-slow")]

# --- rule thresholds (fixed values) ---
RECON_REVIEWS = 5
DESTRUCT_DELETES = 5
HIJACK_WORKLOADS = 1
HYSTERESIS_K = 2
MAX_CLASS_WEIGHT = 11.0

# --- token signatures (fixed values) ---
SIGNATURE_TOKENS = [
    "get:secrets:", "list:secrets:", "create:clusterrolebindings:",
    "create:serviceaccounts:token", "create:serviceaccounts:", "create:pods:",
]
DISTINCT_TOKENS = [
    "get:secrets:", "get:pods:exec", "create:clusterrolebindings:", "delete:clusterrolebindings:",
]

# --- severity bands, highest first (fixed values) ---
SEVERITY_BANDS = [("CRITICAL", 0.95), ("HIGH", 0.85), ("MEDIUM", 0.70), ("LOW", 0.50)]

# --- attack chains: name, ordered tokens, boost (fixed values, catalogue order) ---
CHAINS = [
    ("full_kill_chain",
     ["discovery", "credential_theft", "privilege_escalation", "container_escape"], 3.0),
    ("recon_to_escape", ["discovery", "container_exec", "container_escape"], 2.0),
    ("credential_to_escalation", ["credential_theft", "privilege_escalation"], 1.8),
    ("token_to_escalation", ["token_theft", "privilege_escalation"], 1.8),
    ("discovery_to_credential", ["discovery", "credential_theft"], 1.5),
    ("discovery_to_exec", ["discovery", "container_exec"], 1.3),
]

# --- syscall alerts: priority -> score, keywords -> tactic (fixed values) ---
PRIORITY_SCORE = {
    "Emergency": 1.0, "Alert": 0.97, "Critical": 0.95, "Error": 0.90,
    "Warning": 0.85, "Notice": 0.70, "Informational": 0.50, "Debug": 0.30,
}
DEFAULT_PRIORITY_SCORE = 0.70
SYSCALL_COMPONENT = "falco_runtime"
TACTIC_KEYWORDS = [
    (["read sensitive file", "sensitive file opened", "service account token",
      "read environment variable", "ssh", "/etc/shadow"], "credential_theft"),
    (["terminal shell", "shell was spawned", "spawned in a container",
      "drop and execute", "execute new binary", "run shell"], "container_exec"),
    (["escape", "privileged container", "mount", "change thread namespace",
      "container drift", "sensitive mount"], "container_escape"),
    (["contact k8s api server", "k8s api server from container", "service discovery"],
     "discovery"),
]

# --- scenario -> technique (fixed values) ---
TECHNIQUES = [
    ("recon", "T1613", "Container and Resource Discovery", "Discovery"),
    ("exec_abuse", "T1609", "Container Administration Command", "Execution"),
    ("rbac_escalation", "T1078", "Valid Accounts", "Privilege Escalation"),
    ("secret_access", "T1552", "Unsecured Credentials", "Credential Access"),
    ("sa_token_abuse", "T1528", "Steal Application Access Token", "Credential Access"),
    ("malicious_pod", "T1610", "Deploy Container", "Execution / Priv. Esc."),
]

# --- flow tables: labels and identifiers (fixed values) ---
LABEL_COLUMNS = [
    "label", "Label", "LABEL", "attack", "Attack", "ATTACK", "class", "Class", "CLASS",
    "type", "Type", "TYPE", "category", "Category", "CATEGORY", "is_attack", "is_ddos",
    "ddos", "traffic_type", "traffic_category",
]
LABEL_SUBSTRINGS = ["label", "attack", "ddos"]
BENIGN_LABELS = ["benign", "normal", "legitimate", "0", "false", "no"]
BENIGN_LABELS_WIDE = BENIGN_LABELS + ["none"]
DDOS_SUBSTRINGS = ["ddos", "dos", "flood"]
IDENTIFIER_COLUMNS = [
    "flow_id", "timestamp", "src_ip", "dst_ip", "source_ip", "destination_ip", "src_port",
    "dst_port", "source_port", "destination_port", "activity",
]
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}

# --- columns that hold a flow measure, first match counts (fixed values) ---
FLOW_ALIASES = {
    "duration": ["duration_s", "duration", "flow_duration", "Flow Duration"],
    "packets": ["packets_count", "tot_pkts", "total_packets"],
    "fwd_packets": ["fwd_packets_count", "tot_fwd_pkts", "total_fwd_packets", "Total Fwd Packets",
                    "Tot Fwd Pkts"],
    "bwd_packets": ["bwd_packets_count", "tot_bwd_pkts", "total_bwd_packets", "Total Backward Packets",
                    "Tot Bwd Pkts"],
    "bytes": ["tot_bytes", "total_bytes", "bytes", "bytes_count"],
    "fwd_bytes": ["Total Length of Fwd Packets", "TotLen Fwd Pkts"],
    "bwd_bytes": ["Total Length of Bwd Packets", "TotLen Bwd Pkts"],
}
FLOW_ADDRESSES = {"src_ip": ["src_ip", "source_ip", "Src IP", "Source IP"],
                  "dst_ip": ["dst_ip", "destination_ip", "Dst IP", "Destination IP"]}
FLOW_PORTS = {"src_port": ["src_port", "source_port", "Src Port", "Source Port"],
              "dst_port": ["dst_port", "destination_port", "Dst Port", "Destination Port"]}
FLOW_PROTOCOL = ["protocol", "Protocol"]
FLOW_SECONDS_AT_MOST = 1000
FLOW_PACKET_BYTES = 1500

# --- foreign flow column -> canonical name (fixed values) ---
FLOW_COLUMN_MAP = {
    "Flow ID": "flow_id", "Src IP": "src_ip", "Src Port": "src_port", "Dst IP": "dst_ip",
    "Dst Port": "dst_port", "Protocol": "protocol", "Timestamp": "timestamp",
    "Flow Duration": "duration", "Total Fwd Packet": "fwd_packets_count",
    "Total Bwd packets": "bwd_packets_count",
    "Total Length of Fwd Packet": "fwd_total_payload_bytes",
    "Total Length of Bwd Packet": "bwd_total_payload_bytes",
    "Fwd Packet Length Max": "fwd_payload_bytes_max",
    "Fwd Packet Length Min": "fwd_payload_bytes_min",
    "Fwd Packet Length Mean": "fwd_payload_bytes_mean",
    "Fwd Packet Length Std": "fwd_payload_bytes_std",
    "Bwd Packet Length Max": "bwd_payload_bytes_max",
    "Bwd Packet Length Min": "bwd_payload_bytes_min",
    "Bwd Packet Length Mean": "bwd_payload_bytes_mean",
    "Bwd Packet Length Std": "bwd_payload_bytes_std",
    "Flow Bytes/s": "bytes_rate", "Flow Packets/s": "packets_rate",
    "Flow IAT Mean": "packets_IAT_mean", "Flow IAT Std": "packet_IAT_std",
    "Flow IAT Max": "packet_IAT_max", "Flow IAT Min": "packet_IAT_min",
    "Fwd IAT Total": "fwd_packets_IAT_total", "Fwd IAT Mean": "fwd_packets_IAT_mean",
    "Fwd IAT Std": "fwd_packets_IAT_std", "Fwd IAT Max": "fwd_packets_IAT_max",
    "Fwd IAT Min": "fwd_packets_IAT_min",
    "Bwd IAT Total": "bwd_packets_IAT_total", "Bwd IAT Mean": "bwd_packets_IAT_mean",
    "Bwd IAT Std": "bwd_packets_IAT_std", "Bwd IAT Max": "bwd_packets_IAT_max",
    "Bwd IAT Min": "bwd_packets_IAT_min",
    "Fwd PSH Flags": "fwd_psh_flag_counts", "Bwd PSH Flags": "bwd_psh_flag_counts",
    "Fwd URG Flags": "fwd_urg_flag_counts", "Bwd URG Flags": "bwd_urg_flag_counts",
    "Fwd RST Flags": "fwd_rst_flag_counts", "Bwd RST Flags": "bwd_rst_flag_counts",
    "Fwd Header Length": "fwd_total_header_bytes", "Bwd Header Length": "bwd_total_header_bytes",
    "Fwd Packets/s": "fwd_packets_rate", "Bwd Packets/s": "bwd_packets_rate",
    "Packet Length Min": "payload_bytes_min", "Packet Length Max": "payload_bytes_max",
    "Packet Length Mean": "payload_bytes_mean", "Packet Length Std": "payload_bytes_std",
    "Packet Length Variance": "payload_bytes_variance",
    "FIN Flag Count": "fin_flag_counts", "SYN Flag Count": "syn_flag_counts",
    "RST Flag Count": "rst_flag_counts", "PSH Flag Count": "psh_flag_counts",
    "ACK Flag Count": "ack_flag_counts", "URG Flag Count": "urg_flag_counts",
    "CWR Flag Count": "cwr_flag_counts", "ECE Flag Count": "ece_flag_counts",
    "Down/Up Ratio": "down_up_rate", "Average Packet Size": "avg_segment_size",
    "Fwd Segment Size Avg": "fwd_avg_segment_size",
    "Bwd Segment Size Avg": "bwd_avg_segment_size",
    "Fwd Bytes/Bulk Avg": "avg_fwd_bytes_per_bulk",
    "Fwd Packet/Bulk Avg": "avg_fwd_packets_per_bulk",
    "Fwd Bulk Rate Avg": "avg_fwd_bulk_rate",
    "Bwd Bytes/Bulk Avg": "avg_bwd_bytes_per_bulk",
    "Bwd Packet/Bulk Avg": "avg_bwd_packets_bulk_rate",
    "Bwd Bulk Rate Avg": "avg_bwd_bulk_rate",
    "Subflow Fwd Packets": "subflow_fwd_packets", "Subflow Fwd Bytes": "subflow_fwd_bytes",
    "Subflow Bwd Packets": "subflow_bwd_packets", "Subflow Bwd Bytes": "subflow_bwd_bytes",
    "FWD Init Win Bytes": "fwd_init_win_bytes", "Bwd Init Win Bytes": "bwd_init_win_bytes",
    "Fwd Seg Size Min": "fwd_min_header_bytes",
    "Active Mean": "active_mean", "Active Std": "active_std",
    "Active Max": "active_max", "Active Min": "active_min",
    "Idle Mean": "idle_mean", "Idle Std": "idle_std",
    "Idle Max": "idle_max", "Idle Min": "idle_min", "Label": "label",
}

# --- one-hot widths of the tabular audit features (fixed values) ---
ONEHOT_WIDTH = {"verb": 12, "resource": 25, "subresource": 8, "api_group": 8, "namespace": 8}
BODY_FLAGS = ["pod_privileged", "pod_host_path", "pod_host_pid", "pod_host_network",
              "pod_host_ipc", "rbac_wildcard"]

# --- packet context networks (fixed values) ---
POD_NETWORK = "10.244.0.0/16"
SERVICE_NETWORK = "10.96.0.0/12"
TCP_FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}

# --- class balance bands, highest first (fixed values) ---
BALANCE_BANDS = [
    (0.9, "HIGHLY BALANCED"), (0.7, "MODERATELY BALANCED"),
    (0.5, "SLIGHTLY IMBALANCED"), (0.3, "IMBALANCED"),
]
BALANCE_FLOOR = "HIGHLY IMBALANCED"

# Categories of audit rows in the log store.
LOG_CATEGORIES = ("kube-audit", "kube-audit-admin")
