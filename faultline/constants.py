"""Word lists, patterns, weights and texts that results depend on."""

from __future__ import annotations

# ---- fixed values: normalisation ----
NULL_TOKENS = ("", "NULL", "null", "None")
LOCATION_TYPES = ("ADDRESSES", "CITYFACILITIES", "CITY FACILITIES", "CITY DEPTS", "STREETSTRAFFIC", "SERVICE ZONE")
PRIMARY_ROLES = ("appliesto", "primary", "asset", "subject")
FALLBACK_ROLES = ("attached", "context", "related")
CATCH_ALL_ASSETS = ("CITYFACILITIES:0", "CITYFACILITIES:642", "CITY_DEPTS:LEGAL", "CITY_DEPTS:MIS")
MAX_ASSETS_PER_JOB = 10
CATCH_ALL_JOBS = 500
BOILERPLATE_SHARE, BOILERPLATE_LEAST, BOILERPLATE_LENGTH = 0.08, 4, 120

# ---- fixed values: aliases of source columns, first present wins ----
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "work_orders": {
        "work_order_id": ("WorkOrderId", "work_order_id", "WOID"),
        "date": ("InitiateDate", "CreatedDate", "OccurredAt", "Date", "OpenDate"),
        "description": ("Description", "Summary", "Title"),
        "category": ("AssetGroup", "Category", "WorkType", "Type"),
        "department": ("Shop", "Department", "Division", "Agency"),
        "status": ("Status", "WorkOrderStatus"),
        "priority": ("Priority", "Severity"),
        "address": ("WOAddress", "Address"),
        "location": ("Location",),
        "is_reactive": ("IsReactive",),
        "text10": ("Text10",),
        "apply_to_entity": ("ApplyToEntity",),
    },
    "entities": {
        "work_order_id": ("WorkOrderId", "work_order_id", "WOID"),
        "entity_type": ("EntityType", "entity_type", "AssetType"),
        "entity_uid": ("EntityUid", "entity_uid", "AssetId"),
        "role": ("RelationshipType", "Relation", "Role"),
    },
    "comments": {
        "comment_id": ("CommentId", "comment_id", "Id"),
        "work_order_id": ("WorkOrderId", "work_order_id", "WOID"),
        "created_at": ("DateCreated", "CreatedDate", "CommentDate", "Date"),
        "text": ("Comments", "Comment", "CommentText", "Text", "Notes"),
        "kind": ("ActivityType", "CommentType", "SourceType", "Type"),
    },
}
REQUIRED = {"work_orders": ("work_order_id", "date"), "entities": ("work_order_id", "entity_type", "entity_uid"), "comments": ("work_order_id", "text")}
SOURCE_FILES = {"work_orders": "WORKORDER", "entities": "WOENTITY", "comments": "WOCOMMENT"}

# ---- fixed values: notes ----
SCAFFOLD = (
    r"(?is)^\s*from:\s*request id:.*?\bproblem details:\s*",
    r"(?im)^\s*from:\s*request id:.*$",
    r"(?im)^\s*problem details:\s*",
    r"(?im)^\s*problem comments:\s*",
)
BOILERPLATE = (
    r"(?i)^work order (created|assigned|closed)( automatically)?[.!]*$",
    r"(?i)^status (changed|updated) to .+$",
    r"(?i)^dispatched to crew[.!]*$",
    r"(?i)^notification sent[.!]*$",
    r"(?i)^please advise[.!]*$",
    r"(?i)^no comment[.!]*$",
)
SYSTEM_PREFIXES = ("system:", "auto-generated:", "workflow:")
MEANINGLESS = ("ok", "done", "complete", "completed", "n/a", "na", "test", "none")
NOT_MAINTENANCE = (
    r"(?i)\bjanitorial suppl(?:y|ies)\b",
    r"(?i)\bsupply order\b",
    r"(?i)\b(?:attend(?:ed)?|staff) (?:a )?(?:training|meeting|conference)\b",
    r"(?i)\btraining (?:class|course|session)\b",
)

# ---- fixed values: redaction, in order (kind, pattern, replacement) ----
PII = (
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL_REDACTED]"),
    ("PHONE", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]*\d{3}[-.\s]\d{4}(?!\d)", "[PHONE_REDACTED]"),
    ("EMPLOYEE_ID", r"(?i)\b(?:employee|emp|badge|tech)\s*(?:id|#|no\.?)?\s*[:#-]?\s*[A-Z]{0,3}-?\d{4,8}\b", "[EMPLOYEE_ID_REDACTED]"),
    (
        "PERSON_NAME",
        r"(?i)\bby\s+(?!(?:replac\w*|repair\w*|inspect\w*|check\w*|install\w*|patch\w*|clear\w*|reset\w*|seal\w*)\b)"
        r"[a-z][a-z'-]{1,30}(?:\s+[a-z][a-z'-]{1,30})?,\s*[a-z][a-z'-]{1,30}(?:\s+[a-z][a-z'-]{1,30})?\s*:",
        "By [PERSON_REDACTED]:",
    ),
    (
        "PERSON_NAME",
        r"(?i)\b(?:contact|technician|caller|reported by|dispatched to)\s*[:=-]?\s*(?!(?:check|replace|repair|inspect|pump|valve|site|work|crew|shop|"
        r"evidence|record|records|note|notes|maintenance|intervention|signal)\b)[a-z][a-z'-]+\s+[a-z][a-z'-]+\b",
        "[PERSON_REDACTED]",
    ),
    (
        "PERSON_NAME",
        r"\b[A-Z][a-z]{1,24}(?:-[A-Z][a-z]{1,24})?\s+[A-Z][a-z]{1,30}(?:'[A-Z][a-z]{1,30})?(?='s\s+(?:office|desk|cubicle|workspace)\b)",
        "[PERSON_REDACTED]",
    ),
)
EXTERNAL = (
    (
        "ADDRESS",
        r"(?i)\b\d{1,6}\s+(?:[NESW]\.?(?:\s+|$))?(?:[A-Z0-9.'-]+\s+){0,5}(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|"
        r"court|ct|place|pl|parkway|pkwy|highway|hwy|way|circle|cir|terrace|ter)\b(?:\s*(?:#|apt|suite|unit)\s*[A-Z0-9-]+)?",
        "[ADDRESS_REDACTED]",
    ),
    ("ADDRESS", r"(?i)\bP\.?\s*O\.?\s+Box\s+\d+[A-Z0-9-]*\b", "[ADDRESS_REDACTED]"),
    (
        "LOCATION",
        r"\b(?:\d{1,3}(?:st|nd|rd|th)|[A-Z][A-Za-z0-9'-]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr))\s*"
        r"(?:&|and)\s*(?:\d{1,3}(?:st|nd|rd|th)|[A-Z][A-Za-z0-9'-]+(?:\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr))?)\b",
        "[LOCATION_REDACTED]",
    ),
    ("LOCATION", r"(?i)\b(?:ADDRESSES?|CITYFACILITIES|CITY[ _]FACILITIES):[A-Z0-9_-]+\b|\b(?:room|suite|office)\s*[#:-]?\s*[A-Z]?\d+[A-Z0-9-]*\b", "[LOCATION_REDACTED]"),
    ("COORDINATES", r"(?<!\d)-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}(?!\d)", "[COORDINATES_REDACTED]"),
)

# ---- fixed values: note signals ----
REPAIR_TERMS = (
    "replaced", "repaired", "patched", "cleared", "reset", "sealed", "installed", "added refrigerant", "charged unit", "changed light",
    "changed bulb", "changed ballast", "repair complete", "repaired complete", "repair work completed", "patching completed",
)
RESOLUTION_TERMS = ("resolved", "returned to service", "no additional complaint", "operating normally", "working properly", "unit running")
NO_ISSUE_TERMS = ("no problem found", "no issue found", "unable to reproduce")
CONFLICT_TERMS = (
    "not resolved", "issue returned", "still leaking", "still broken", "still not working", "not cooling", "no cooling", "not heating",
    "no heat", "failed again", "called back", "recurring",
)
NOTE_PATTERNS = {
    "no_problem_found": NO_ISSUE_TERMS,
    "jetting_or_line_cleaning": ("jetting", "jetted line", "line cleaning", "cleaned line"),
    "repeat_or_still_broken": CONFLICT_TERMS,
    "roots_or_grease": ("roots in line", "root intrusion", "grease in line", "grease buildup"),
    "reconnect_action": ("reconnect", "reconnection", "restore service", "turn on service"),
}
FOLLOW_UP_TERMS = (
    "again", "returned", "prior", "previous", "remains", "continued", "repaired", "replaced", "cleared", "cleaned", "jetted", "restored",
    "inspection", "inspected", "reset", "reconnected",
)
CAUSE_MARKERS = ("caused by", "due to", "resulted from", "root cause was")
HEDGED_CAUSES = (
    "not due to", "not caused by", "may be due to", "might be due to", "could be due to", "possibly due to", "suspected to be due to",
    "delayed due to", "delay due to", "closing due to", "closed due to", "cancelled due to", "canceled due to",
)
CONTRADICTIONS = ("no issue found", "unable to reproduce", "not maintenance related")

# ---- fixed values: issue families in order, each with keywords, exemplars and the pattern that supports it ----
# (patterns of two lookaheads are tied to the start of a line, which finds the same and takes linear time)
UNKNOWN = "unknown"
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "main_break": (
        ("main break", "broken main", "water main burst", "water line break", "broke the main"),
        ("water main or water line is broken busted burst or gushing", "water is coming up through pavement above a broken main"),
        r"(?im)^(?=.*\bwater (?:main|line)\b)(?=.*\b(?:break\w*|broke|burst|busted|gushing)\b)",
    ),
    "low_pressure": (
        ("low pressure", "no pressure", "pressure dropped", "weak flow", "no water pressure"),
        ("service has very low weak intermittent or no water pressure", "water flow is weak and there is not enough pressure"),
        r"(?i)\b(?:low|no|weak|intermittent) (?:water )?pressure\b|\b(?:pressure drop\w*|weak water flow)\b",
    ),
    "water_leak": (
        ("water leak", "leaking", "standing water", "service line leak", "water running", "leak at meter"),
        ("surfacing water leak; standing water leak; leaking service line", "leaking water meter; leaking hydrant; leaking water line"),
        r"(?i)\b(?:standing water|water (?:running|surfacing|bubbling|gushing)|water coming (?:up|from))\b|"
        r"\b(?:water|water main|water line|service line|hydrant|water meter)\b[^.!?]{0,80}\bleak\w*\b|"
        r"\bleak\w*\b[^.!?]{0,80}\b(?:water|water main|water line|service line|hydrant|water meter)\b",
    ),
    "sewer_backup": (
        (
            "sewer backup", "sewer backups", "backed up", "back up", "stopped up", "stop up", "stoppage", "overflowing sewer", "blocked sewer",
            "roots in line", "grease in line", "jetted line", "line cleaning",
        ),
        ("sewer drain or manhole is backed up stopped clogged blocked or overflowing", "roots grease or another blockage are restricting the sewer line"),
        r"(?im)^(?=.*\b(?:sewer|drain|manhole)\b)(?=.*\b(?:backups?|backed up|stoppage|clog\w*|block\w*|overflow\w*|roots?|grease)\b)",
    ),
    "pothole": (
        ("pothole", "hole in roadway"),
        ("pothole; road surface hole; roadway cavity", "sunken road hole; washed out road hole"),
        r"(?i)\bpotholes?\b|\b(?:road|roadway|street|lane|pavement)\b[^.!?]{0,120}\b(?:hole|cavity|depression)\b|"
        r"\b(?:hole|cavity|depression)\b[^.!?]{0,120}\b(?:road|roadway|street|lane|pavement)\b",
    ),
    "pavement_damage": (
        ("pavement", "asphalt", "road crack", "surface failure"),
        ("pavement or asphalt is cracked deteriorating rough or failing", "roadway surface is sinking or washed out"),
        r"(?im)^(?=.*\b(?:pavement|asphalt|roadway|road surface)\b)(?=.*\b(?:crack\w*|deteriorat\w*|rough|fail\w*|sink\w*|washed out|damage\w*)\b)",
    ),
    "meter_failure": (
        ("meter failed", "meter not reading", "meter fault", "bad meter", "meter problem", "changeout meter"),
        ("meter not reading; unreadable meter register", "damaged meter; stuck meter; broken meter"),
        r"(?i)\b(?:meter|register|endpoint)\b[^.!?]{0,60}\b(?:not reading|unreadable|failed read|fault\w*|broken|damaged|stuck)\b|"
        r"\b(?:not reading|unreadable|failed read|fault\w*|broken|damaged|stuck)\b[^.!?]{0,60}\b(?:meter|register|endpoint)\b|\bmeter problem\b",
    ),
    "hvac_failure": (
        ("hvac", "air handler", "no heat", "no cooling", "no cool", "a/c", "air cond", "not producing cold air", "compressor"),
        ("air conditioner not cooling; warm air conditioner", "heater failure; furnace failure; compressor failure; HVAC fan failure"),
        r"(?i)\b(?:no heat|no cool(?:ing)?)\b|\b(?:hvac|air conditioner|air handler|heater|furnace|compressor|thermostat|fan)\b[^.!?]{0,80}"
        r"\b(?:fail\w*|not working|warm air|broken|out|off)\b|\b(?:fail\w*|not working|warm air|broken|out|off)\b[^.!?]{0,80}"
        r"\b(?:hvac|air conditioner|air handler|heater|furnace|compressor|thermostat|fan)\b",
    ),
    "electrical_issue": (
        ("electrical", "power outage", "breaker", "streetlight", "streetlights out", "short circuit"),
        ("street light or security light is out blinking flickering or cycling", "electrical service has no power exposed wires a short or a tripped breaker"),
        r"(?im)^(?=.*\b(?:lights?|streetlights?|power|electrical|breaker|wire|circuit)\b)"
        r"(?=.*\b(?:out|off|outage|blink\w*|flicker\w*|cycl\w*|trip\w*|short|exposed|broken|fail\w*)\b)",
    ),
    "reconnect": (
        ("reconnect", "reconnection", "restore service", "turn on service", "service turn on"),
        ("restore water or electric service after a disconnect", "reconnect service or turn service back on"),
        r"(?i)\breconnect\w*\b|\breconnection\b|\b(?:restore|turn on)\s+(?:water|electric)?\s*service\b",
    ),
}
EXEMPLAR_SCORE, EXEMPLAR_MARGIN = 0.195, 0.03

# ---- fixed values: edges, groups, confidence, risk ----
EDGE_WEIGHTS = {"semantic": 0.35, "asset": 0.30, "temporal": 0.15, "issue": 0.20}
EDGE_THRESHOLD, SPAN_DAYS, PAIR_DAYS, NEIGHBOURS = 0.60, 180, 365, 12
CONFIDENCE_WEIGHTS = {"semantic_consistency": 0.25, "asset_consistency": 0.20, "temporal_consistency": 0.15, "evidence_strength": 0.20, "issue_agreement": 0.20}
HIGH, MEDIUM, REVIEW = 0.82, 0.65, 0.72
HIGH_PRIORITIES = ("high", "urgent", "emergency")
UNRESOLVED_SIGNALS = ("UNRESOLVED", "UNKNOWN", "REPAIR_RECORDED")
RISK_HIGH = 65

# ---- fixed values: texts of the rule table: family, label, interpretation, possible cause, action ----
RULES = (
    ("water_leak", "Water leak", "Evidence indicates a recurring leak episode on the same infrastructure asset.",
     "Connection, seal, or service-line degradation may be contributing to repeated leakage.",
     "Inspect joints, seals, and the connected service line; prioritize a pressure/leak test before failure."),
    ("main_break", "Water main break", "The sequence is consistent with a water-main failure episode requiring follow-up.",
     "Pipe-wall deterioration or external loading may be contributing; the evidence does not distinguish them.",
     "Review break history and pipe attributes, then schedule condition assessment of the adjacent main segment."),
    ("low_pressure", "Low water pressure", "Evidence indicates a recurring pressure issue rather than isolated service requests.",
     "Valve or service-line degradation may be contributing to recurring pressure complaints.",
     "Schedule pressure testing and inspection of the associated valve and service line."),
    ("sewer_backup", "Sewer backup", "The work-order sequence indicates recurring loss of collection-line capacity.",
     "Root intrusion, debris, or pipe deformation may be contributing; camera evidence is needed.",
     "Schedule CCTV inspection and targeted cleaning; compare findings with the prior blockage location."),
    ("pothole", "Pothole recurrence", "The defect returned after prior surface treatment, indicating repeat pavement failure.",
     "Water infiltration or base failure may be contributing to patch failure.",
     "Inspect drainage and pavement base before selecting a durable full-depth repair."),
    ("pavement_damage", "Pavement damage", "Related pavement observations show progression or recurrence on the same segment.",
     "Subgrade, drainage, or loading conditions may be contributing; available notes are inconclusive.",
     "Perform condition survey and core sampling before selecting rehabilitation treatment."),
    ("meter_failure", "Meter failure", "Repeated read exceptions indicate an intermittent or recurring meter-system fault.",
     "Register or endpoint degradation may be contributing to repeated read failures.",
     "Compare register and endpoint diagnostics; replace only the component confirmed by field testing."),
    ("hvac_failure", "HVAC failure", "The building equipment shows a recurring loss-of-service pattern.",
     "Control, actuator, or compressor degradation may be contributing; evidence is not conclusive.",
     "Trend temperatures and controls, then inspect the repeatedly implicated subsystem before peak load."),
    ("electrical_issue", "Electrical fault", "Repeat outages indicate an electrical episode that warrants load and component inspection.",
     "A breaker, contactor, or downstream load may be contributing; the current evidence is limited.",
     "Perform load testing and thermal inspection of the affected circuit and protective devices."),
    ("reconnect", "Service reconnection", "The records describe a service-restoration workflow that should be checked against the prior disconnect event.",
     "The available records show a restoration action but do not establish why service was disconnected.",
     "Verify authorization, service state, and the meter or electrical safety check before closing the workflow."),
    ("unknown", "Unclassified maintenance pattern", "Related work orders were found, but the issue family is not reliably classified.",
     "Insufficient evidence to determine cause.",
     "Review source notes and assign an issue family before scheduling preventive work."),
)
NOT_RECURRING = "The records form one related episode, but fewer than three work orders are available; recurrence cannot yet be established."
MONITOR = "Monitor for recurrence and verify the recorded disposition before preventive work is authorized."
NO_CAUSE = "Insufficient evidence to determine cause."
CLAIM_FIELDS = ("summary", "observations", "interpretation", "possible_cause", "recommended_action", "pm_interval_recommendation")
CITATION = r"(?i)\bWorkOrderIds?\s*:\s*([^\n.;)]*)"

# ---- fixed values: sections of the briefing in order, and why no interval is recommended ----

SECTIONS = (
    "Executive Summary", "High-Risk Equipment", "Recurring Maintenance Patterns", "Evidence-Based Findings", "Preventive Maintenance Recommendations",
    "Low-Confidence Findings Requiring Review",
)
ABSTAIN_NOT_RECURRING = "The episode is not classified as recurring; no PM cadence is inferred."
ABSTAIN_FEW_JOBS = ("At least three work orders classified as ", " are required to infer a PM interval.")
ABSTAIN_FEW_GAPS = "At least two positive recurrence gaps are required; the available episode dates do not provide enough time-separated evidence."

#: Hex digits of the digest in an incident's id. Of 8 digits, half a million incidents share some 34 ids.
ID_DIGITS = 24
