"""Fixed values of the ranking model: each must equal the published model's for right results."""

from __future__ import annotations

# fixed values: yearly decay rate by domain, the rate of any other domain, days of a year
DECAY_RATES = {"infectious_disease": 0.20, "oncology": 0.15, "cardiology": 0.10, "pbm": 0.12, "surgery": 0.08, "anatomy": 0.02}
DEFAULT_DECAY = 0.12
YEAR_DAYS = 365.25

# fixed values: evidence levels with name, weight, bounds of the 95 % interval, and keywords
EVIDENCE = [
    (1, "SYSTEMATIC_REVIEW", 1.00, 1.00, 1.00, ["systematic review", "meta-analysis", "cochrane"]),
    (2, "RCT", 0.85, 0.78, 0.92, ["randomized", "randomised", "rct", "clinical trial"]),
    (3, "CONTROLLED_OBSERVATIONAL", 0.65, 0.55, 0.75, ["cohort", "case-control", "propensity"]),
    (4, "UNCONTROLLED_OBSERVATIONAL", 0.45, 0.35, 0.55, ["case series", "case report", "retrospective"]),
    (5, "EXPERT_OPINION", 0.25, 0.15, 0.35, ["expert opinion", "consensus", "editorial"]),
]
DEFAULT_LEVEL = 4
DEFAULT_EVIDENCE_WEIGHT = 0.5

# fixed values: signals of actionability, weights of the composite, bounds of an unbounded population
ACTION_SIGNALS = ["recommend", "guideline", "threshold", "should be", "dose", "protocol"]
COMPONENT_WEIGHTS = {"topic": 0.50, "apply": 0.30, "action": 0.20}
AGE_LOW, AGE_HIGH, UNKNOWN_APPLICABILITY = 0.0, 120.0, 0.5

# fixed values: lexical and hybrid search
K1, B, BETA = 1.5, 0.75, 0.4
SEARCH_K, POOL_K, RERANK_K, CUTOFF = 10, 100, 10, 10
MINIMUM_IMPROVEMENT, EQUIVALENCE_MARGIN = 0.05, 0.03

# fixed values: modules and the gates that a question type opens (1) or closes (0)
MODULES = ["bm25", "topical", "evidence", "temporal", "applicability", "actionability"]
GATES = {
    "treatment": [1, 1, 1, 1, 1, 1],
    "diagnosis_test": [1, 1, 0, 1, 1, 1],
    "prognosis": [1, 1, 0, 1, 1, 0],
    "other": [1, 1, 0, 0, 0, 0],
}
# fixed values: permuted gate columns by seed, in the order of GATES
GATE_PERMUTATIONS = [
    ["prognosis", "treatment", "diagnosis_test", "other"],
    ["treatment", "diagnosis_test", "prognosis", "other"],
    ["other", "prognosis", "treatment", "diagnosis_test"],
    ["other", "prognosis", "diagnosis_test", "treatment"],
    ["other", "treatment", "diagnosis_test", "prognosis"],
]
# fixed values: patterns of question types, in order, on lower-cased text
QUESTION_RULES = [
    ("treatment", r"\b(treat|therap|drug|dose|dosing|supplement|intervention|prevent)"),
    ("diagnosis_test", r"\b(diagnos|tests?\b|testing\b|screen|detect|marker|imaging)"),
    ("prognosis", r"\b(prognos|survival|risk of|outcome|mortality|recurrence)"),
]
# fixed values: topic type to gate column, publication type to evidence level
TOPIC_COLUMNS = {"diagnosis": "diagnosis_test", "test": "diagnosis_test", "treatment": "treatment"}
PUBLICATION_LEVELS = {
    "Systematic Review": 1, "Meta-Analysis": 1, "Randomized Controlled Trial": 2, "Controlled Clinical Trial": 3, "Clinical Trial": 3,
    "Observational Study": 3, "Comparative Study": 3, "Case Reports": 4, "Editorial": 5, "Comment": 5, "Letter": 5, "Consensus Development Conference": 5,
}
# fixed values: pairs sampled per query, penalties tried, least share of changed rankings and of dated documents
PAIRS_PER_QUERY, PENALTIES = 500, [0.001, 0.01, 0.1, 1.0, 10.0]
MANIPULATION_SHARE, DATE_COVERAGE = 0.5, 0.95
# fixed values: random orders of a pool, resamples of a mean, sign flips
RANDOM_ORDERS, BOOTSTRAP_DRAWS, SIGN_FLIPS = 200, 10_000, 10_000
