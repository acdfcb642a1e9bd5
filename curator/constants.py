"""Fixed values that results depend on."""

# Query keys dropped when URLs are compared (plus every utm_* key).
TRACKING_KEYS = ("gclid", "dclid", "fbclid", "igshid", "mc_cid", "mc_eid", "yclid")
# Query keys dropped from identity URLs (plus every utm_* key).
IDENTITY_TRACKING_KEYS = ("fbclid", "gclid", "msclkid", "igshid")
# Object keys searched for links, in order of preference.
LINK_KEYS = ("original", "originalUrl", "original_url", "canonical", "url", "href", "link")
# The link keys that declare an original rather than a discovery page.
ORIGINAL_LINK_KEYS = ("original", "originalUrl", "original_url", "canonical")

# Source classes with first-hand evidence, best first.
PRIMARY_CLASSES = ("primary_official", "open_source", "research")
AGGREGATOR = "aggregator"
# Similarity threshold and window of story clustering.
TITLE_THRESHOLD = 0.48
WINDOW_HOURS = 72
# Similarity threshold and window of the recent-decision check.
RECENT_THRESHOLD = 0.85
RECENT_DAYS = 14

# Additive score weights and penalties.
SCORE_WEIGHTS = {
    "audience_value": 25, "evidence": 20, "novelty": 15, "timeliness": 15,
    "audience_fit": 10, "explainability": 10, "production_cost_fit": 5,
}
SCORE_PENALTIES = {
    "discovery_only": -20, "recent_decision_similarity": -20,
    "weak_evidence_language": -15, "non_workflow_noise": -15,
}
# Term lists of the additive score.
WORKFLOW_TERMS = (
    "agent", "workflow", "api", "tool", "model", "automation", "creator", "mcp",
    "智能体", "工作流", "自动化", "模型", "工具",
)
WEAK_EVIDENCE_TERMS = (
    "rumor", "rumored", "reportedly", "allegedly", "据称", "传闻", "听说",
)
NOISE_TERMS = (
    "funding", "fundraise", "financing", "stock", "share price", "celebrity",
    "融资", "股价", "名人",
)
# Penalty explanations.
PENALTY_REASONS = {
    "discovery_only": "仅有聚合发现信号，缺少可直接引用的主证据。",
    "recent_decision_similarity": "与最近 14 天已决选题过于相似。",
    "weak_evidence_language": "标题或摘要含有传闻性质的弱证据词。",
    "non_workflow_noise": "内容偏融资、股价或名人争议，未体现普通读者工作流价值。",
}

# Candidate categories in display order, kinds, ranking levels.
CATEGORIES = (
    "开源项目", "Skills", "AI 应用", "Agent 框架与编排",
    "MCP 服务与连接器", "模型与运行工具", "游戏", "博客、帖子与访谈",
)
KINDS = ("project", "update", "reading", "news")
RANKINGS = ("daily", "weekly", "monthly")
DUE_HOURS = {"daily": 9, "weekly": 10, "monthly": 11}
COLLECT_HOUR = 19
LOCAL_HOURS = 8  # the natural-period calendar is fixed UTC+8
PERIOD_LABELS = {"new": "新发现", "carried": "往期候选", "backfilled": "原期事件补采"}
VERIFICATION_LEVELS = ("documented", "demo", "tested")

# Weighted score policy.
DIMENSIONS = ("value", "novelty", "evidence", "usability", "interest")
PROFILES = {
    "practical": {"value": 4, "novelty": 1, "evidence": 1, "usability": 3, "interest": 1},
    "learning": {"value": 3, "novelty": 2, "evidence": 2, "usability": 2, "interest": 1},
    "play": {"value": 1, "novelty": 2, "evidence": 1, "usability": 2, "interest": 4},
    "reading": {"value": 3, "novelty": 3, "evidence": 2, "usability": 1, "interest": 1},
    "news": {"value": 3, "novelty": 3, "evidence": 3, "usability": 1, "interest": 0},
}
CATEGORY_PROFILES = {
    "开源项目": "practical", "Skills": "practical", "AI 应用": "practical",
    "Agent 框架与编排": "learning", "MCP 服务与连接器": "practical",
    "模型与运行工具": "learning", "游戏": "play", "博客、帖子与访谈": "reading",
}
FLAG_CAPS = {
    "unsupported_promotion": {"value": 4, "evidence": 3},
    "routine_update": {"novelty": 3},
    "unfulfilled_announcement": {"usability": 2, "evidence": 4},
    "unclear_usage": {"usability": 3},
    "reader_mismatch": {"value": 3, "usability": 3},
    "insufficient_usage_evidence": {"evidence": 4, "usability": 4},
}
FLAG_KINDS = {
    "routine_update": ("update", "news"),
    "unfulfilled_announcement": ("project", "update", "reading"),
    "unclear_usage": ("project", "update", "reading"),
    "insufficient_usage_evidence": ("project", "update", "reading"),
}
FLAG_BASIS = {
    "routine_update": "limited_increment",
    "unsupported_promotion": "unsupported_effect_claim",
    "unfulfilled_announcement": "availability_limit",
    "unclear_usage": "usage_path_gap",
    "reader_mismatch": "reader_requirement",
    "insufficient_usage_evidence": "usage_evidence_gap",
}
USAGE_GAPS = {
    "daily": ("actionable_steps",),
    "weekly": ("actionable_steps", "usage_record", "long_term_support"),
    "monthly": ("actionable_steps", "usage_record", "long_term_support"),
}
DEFER_FLAGS = (
    "unsupported_promotion", "unfulfilled_announcement", "unclear_usage",
    "reader_mismatch", "insufficient_usage_evidence",
)
SELECT_AT = 65
REJECT_BELOW = 45
CONFIDENCE_FLOOR = 0.8
THRESHOLD_MARGIN = 5

# Evaluation unit per candidate kind.
EVALUATION_UNITS = {
    "project": "whole_project", "update": "event_increment",
    "news": "event_increment", "reading": "content_and_method",
}

# Pre-release tag pattern and accepted change types.
PRERELEASE = r"(?i)(?:^|[-._])(nightly|alpha|beta|rc|preview|dev)(?:[-._0-9]|$)"
CHANGE_TYPES = ("feature", "security", "deprecation", "breaking", "deployment", "high_impact_fix")

# Passage size target and limit.
PASSAGE_TARGET = 1800
PASSAGE_LIMIT = 2400

# Collection lookback hours, normal and after a failure in the last days.
LOOKBACK_HOURS = 48
FALLBACK_HOURS = 168
FALLBACK_DAYS = 7

# Reading-scope audit patterns.
FULL_READ = (
    r"(?i)\b(?:read|reviewed|checked)\s+(?:the\s+)?(?:full|entire|complete)\s+"
    r"(?:licen[cs]e|document|readme|source|text)\b|"
    r"(?:已(?:经)?(?:完整)?(?:阅读|读)|完整(?:地)?阅读|通读|读完(?:了)?|阅读完(?:了)?)"
    r"[^。；;\n]{0,12}(?:全文|完整|全部|文档|文書|许可证|許可證|licen[cs]e|readme)"
)
NOT_A_READ_CLAIM = (
    r"(?i)\b(?:not|never|unknown|should|must|need|please|before)\b|"
    r"未|尚未|没(?:有)?|需要|须|需|应|請|请"
)
