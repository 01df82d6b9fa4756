"""Parameters of the survey, scenario, decision and corpus steps.

FIXED VALUES: the names, codes, weights, ranges and thresholds below must
equal the behaviour being reproduced for results to match; they are stated
plainly, in their natural order.
"""

from __future__ import annotations

SEED = 42

# --- FIXED VALUES: survey quality control ------------------------------------
MIN_COMPLETION_TIME = 180
ATTENTION_CHECK_COLUMN = "Q31"
ATTENTION_CHECK_ANSWER = 2
MAX_COMMUTE_TIME = 120
MAX_DELAY_RATIO = 5

# --- FIXED VALUES: factor names (attached by position) -----------------------
FACTOR_NAMES = [
    "rerouting_proactiveness",
    "information_dependency",
    "time_reliability_preference",
    "risk_aversion",
    "familiar_route_preference",
    "time_sensitivity",
    "external_info_sensitivity",
    "route_flexibility",
]
N_FACTORS = 8

# --- FIXED VALUES: attitude items used by the factor model -------------------
ATTITUDE_ITEMS = [
    "Q6", "Q7", "Q15", "Q8", "Q9", "Q11", "Q12", "Q13", "Q14", "Q16", "Q17", "Q18", "Q19", "Q20",
    "Q22", "Q23_reversed", "Q25", "Q29", "Q27", "Q30", "Q24", "Q32", "Q26", "Q33", "Q36", "Q37",
    "Q38", "Q34", "Q28", "Q35", "Q40_reversed", "Q41",
]

# --- FIXED VALUES: clustering -------------------------------------------------
N_CLUSTERS = 6
CLUSTER_RESTARTS = 10
TYPE_LABELS = {
    0: "CAUTIOUS_FAMILIAR_INFO_DEPENDENT",
    1: "TIME_SENSITIVE_FLEXIBLE_REROUTER",
    2: "RISK_TOLERANT_INDEPENDENT_NAVIGATOR",
    3: "BALANCED_RATIONAL_DRIVER",
    4: "CONSERVATIVE_PATIENT_FOLLOWER",
    5: "PROACTIVE_TECH_SAVVY_OPTIMIZER",
}

# --- FIXED VALUES: code decoding ----------------------------------------------
GENDER = {1: "male", 2: "female"}
EDUCATION = {1: "high_school", 2: "bachelor", 3: "master", 4: "phd"}
ROUTE_TYPE = {1: "highway", 2: "arterial", 3: "local_street"}
LOCATION = {1: "downtown", 2: "urban", 3: "suburban", 4: "rural"}
OCCUPATION = {1: "manager", 2: "professional", 3: "technician", 4: "clerk", 5: "service", 6: "other"}
INCOME_LEVEL = {"low": [1, 2], "middle": [3, 4, 5], "high": [6, 7]}
HAS_NAVIGATION = {1: True, 2: False}

# --- FIXED VALUES: persona defaults ------------------------------------------
PERSONA_INT_DEFAULTS = {
    "age": ("Q50", 30),
    "commute_time_morning": ("Q1", 30),
    "commute_time_afternoon": ("Q2", 30),
    "congestion_duration_morning": ("Q4", 10),
    "congestion_duration_afternoon": ("Q5", 10),
    "delay_tolerance_planned": ("Q21", 10),
    "delay_tolerance_realtime": ("Q42", 15),
    "reroute_threshold_construction": ("Q16", 3),
    "reroute_threshold_special_event": ("Q17", 3),
    "reroute_threshold_weather": ("Q18", 3),
    "reroute_threshold_congestion": ("Q19", 4),
    "reroute_threshold_accident": ("Q20", 5),
}

# --- FIXED VALUES: scenario generation ----------------------------------------
SCENARIOS_PER_PERSONA = 10
TEMPLATES = [
    # name, origin, destination, trip purpose, weight
    ("commute_morning", "Home", "Office", "commute_to_work", 0.5),
    ("commute_evening", "Office", "Home", "commute_from_work", 0.3),
    ("errand", "Home", "Shopping_Mall", "shopping", 0.2),
]
DELAY_BANDS = [
    # level, low, high (inclusive), weight
    ("minor", 3, 7, 0.3),
    ("moderate", 8, 15, 0.4),
    ("severe", 16, 30, 0.2),
    ("none", 0, 0, 0.1),
]
EVENT_TYPES = [("congestion", 0.50), ("accident", 0.20), ("construction", 0.15), ("weather", 0.10),
               ("special_event", 0.05)]
EVENT_SEVERITY = [("minor", 0.3), ("moderate", 0.5), ("severe", 0.2)]
EVENT_LOCATIONS = ["Main_Ave_Link_1", "Highway_1_Segment_2", "Intersection_A"]
WEATHER = [("clear", 0.70), ("rain", 0.20), ("snow", 0.05), ("fog", 0.05)]
IMPORTANT_MEETING_PROB = 0.15
TIME_BUFFER_RANGE = (0, 30)          # randint: upper bound excluded
TRAVEL_TIME_RATIO = (0.8, 1.2)
ALT_TIME_DIFFERENCE = (0, 5)         # randint: upper bound excluded
FAMILIARITY_USUAL = (0.90, 0.98)
FAMILIARITY_ALT = (0.50, 0.75)
ALT_SMALL_DELAY = (0, 3)             # randint: upper bound excluded
ROUTES = [
    # id, name, description
    ("A", "Usual Route", "via Main_Ave and Highway_1"),
    ("B", "Alternative Route", "via Side_St and Local_Road_2"),
]
MIN_TRAVEL_TIME = 5
MAX_TRAVEL_TIME = 180
MAX_DELAY_TO_NORMAL = 2.0

# --- FIXED VALUES: decision simulation ----------------------------------------
W_TIME = -0.5
W_DELAY = -1.0
W_UNCERTAINTY = -0.8
W_FAMILIARITY = 3.0
UNCERTAINTY_COST = {"low": 0, "moderate": 5, "high": 10}
GUMBEL_SCALE = 1.0
FORCE_REROUTE_PROB = 0.85
MEETING_BOOST = 1.5
TARGET_REROUTE_RATE = (0.35, 0.65)
REASON_KEYWORDS = ["time-sensitive", "risk-averse", "familiar", "delay", "urgent", "saves"]

# --- FIXED VALUES: corpus -----------------------------------------------------
TRAIN_RATIO = 0.9
CHAT_TEMPLATE_PREFIX = "<|im_start|>user\n"
CHAT_TEMPLATE_MIDDLE = "<|im_end|>\n<|im_start|>assistant\n"
CHAT_TEMPLATE_SUFFIX = "<|im_end|>\n"

# --- FIXED VALUES: evaluation -------------------------------------------------
TARGET_ACCURACY = 0.75
TARGET_F1 = 0.80
TARGET_PERPLEXITY = 10.0

# --- FIXED VALUES: survey source columns ---------------------------------------
ROW_NUMBER_COLUMN = "序号"                 # its presence selects the question-text dialect
COMPLETION_TIME_COLUMN = "所用+C1:D851时间"  # seconds taken to complete the questionnaire
PLATFORM_KEY_COLUMN = "ResponseId"
TRIP_PURPOSE_ITEMS = ["Q43", "Q44", "Q45", "Q46", "Q47", "Q48"]

# FIXED VALUES: optional name pools by country and gender; used where a caller asks for real names.
NAME_POOLS = {
    "CN": {"male": ["Zhang Wei", "Li Ming", "Wang Qiang", "Liu Yang", "Chen Hao"],
           "female": ["Wang Fang", "Li Na", "Zhang Li", "Liu Jing", "Chen Min"]},
    "US": {"male": ["John Smith", "Michael Johnson", "David Williams", "James Brown", "Robert Jones"],
           "female": ["Mary Johnson", "Patricia Williams", "Jennifer Brown", "Linda Davis", "Elizabeth Miller"]},
    "UK": {"male": ["James Smith", "John Williams", "David Jones", "Michael Brown", "Daniel Taylor"],
           "female": ["Mary Smith", "Susan Williams", "Margaret Jones", "Sarah Brown", "Jessica Taylor"]},
    "AU": {"male": ["Jack Smith", "William Jones", "Oliver Brown", "James Wilson", "Noah Taylor"],
           "female": ["Emily Smith", "Charlotte Jones", "Olivia Brown", "Amelia Wilson", "Ava Taylor"]},
}
