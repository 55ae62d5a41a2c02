"""Limits, weights, enumerations and word lists.

Results must agree with an existing system, so these values are stated as they are, together and in natural order.
"""

# --- chunking limits (characters) -------------------------------------------------------------------------------
PACK_TARGET_CHARS = 1500
MIN_PREAMBLE_CHARS = 80
MIN_SECTION_CHARS = 25
MIN_PARAGRAPH_CHARS = 80
MAX_SECTION_CHARS = 3500

# --- extraction quality --------------------------------------------------------------------------------------------
MIN_CHARS_PER_PAGE = 200
MIN_CHARS_FOR_RTL_CHECK = 200
RTL_MARGIN = 3
RTL_FUNCTION_WORDS = ["של", "את", "על", "לא", "כי", "אם", "זה", "אל", "כל", "מן", "או"]

# --- document vocabulary -------------------------------------------------------------------------------------------
DOC_TYPES = ["bylaw", "sub_bylaw", "decision", "minutes", "other"]
DOC_STATUSES = ["proposal", "draft", "discussion", "background", "invitation", "adopted"]
FORUMS = [
    "assembly", "committee", "ballot", "sub_committee", "external_law", "external_ruling", "contract",
    "legal_opinion", "report", "notice", "procedure", "budget", "agreement_internal", "other",
]
FORUM_RANK = {"sub_committee": 0, "committee": 1, "assembly": 2, "ballot": 3}
FORUM_LABEL = {"ballot": "קלפי", "assembly": "אסיפה", "committee": "ועד הנהלה", "sub_committee": "ועדת משנה"}
STATUS_LABEL = {
    "proposal": "הצעה", "draft": "טיוטה", "discussion": "דיון",
    "background": "רקע", "invitation": "הזמנה", "adopted": "בתוקף",
}
DOC_TYPE_LABEL = {
    "bylaw": "תקנון ראשי", "sub_bylaw": "תקנון משנה", "decision": "החלטה", "minutes": "פרוטוקול", "other": "אחר",
}
DOC_TYPE_PLURAL = {
    "bylaw": "תקנונים ראשיים", "sub_bylaw": "תקנוני משנה", "decision": "החלטות", "minutes": "פרוטוקולים",
    "other": "אחרים",
}

# file-name cues for the lifecycle status
STATUS_PREFIXES = {
    "proposal": ["הצעה", "הצעת"],
    "discussion": ["סיכום דיון", "לקראת דיון"],
    "background": ["דוח", 'דו"ח', "סקירה", "נייר עמדה", "מצגת"],
    "invitation": ["הזמנה", "זימון", "סדר יום"],
}
DRAFT_CUE = "טיוט"
DRAFT_CUE_WINDOW = 20

# --- retrieval -------------------------------------------------------------------------------------------------------
VECTOR_CAP = {"bylaw": 3, "sub_bylaw": 3, "decision": 6, "minutes": 6, "other": 3}
VECTOR_CAP_DEFAULT = 3
FINAL_CAP = {"bylaw": 2, "sub_bylaw": 2, "decision": 5, "minutes": 5, "other": 2}
FINAL_CAP_DEFAULT = 2
RRF_OFFSET = 60
TITLE_BOOST = 0.03
YEAR_BOOST = 0.03
TITLE_DOCS = 5
TITLE_CHUNKS_PER_DOC = 3
YEAR_CHUNKS_PER_YEAR = 5
YEAR_CHUNKS_TOTAL = 80
RECENCY_TYPES = ["decision", "minutes"]
RECENCY_YEARS = 20
RECENCY_PER_YEAR = 0.0005
FORUM_BOOST = {"ballot": 0.006, "assembly": 0.004, "committee": 0.002, "sub_committee": 0.001}
STATUS_DEMOTION = {
    "proposal": -0.006, "draft": -0.006, "discussion": -0.003, "background": -0.003, "invitation": -0.006,
}
MAX_RANGE_K = 15

# --- governance ------------------------------------------------------------------------------------------------------
AUTO_APPLY_CONFIDENCE = 0.75
MIN_LINK_CONFIDENCE = 0.5
MAX_OPEN_ESCALATIONS = 30
TERMINALS_PER_ESCALATION = 4
RECONCILED_TYPES = ["bylaw", "sub_bylaw", "decision", "minutes"]
NEIGHBORS_PER_CHUNK = 3
MAX_NEIGHBOR_DISTANCE = 0.45
FLAG_KINDS = ["contradicts", "supersedes", "duplicates"]
VERSION_KINDS = ["duplicates", "supersedes"]
MIN_FLAG_CONFIDENCE = 0.5

# --- analytics -------------------------------------------------------------------------------------------------------
LOCAL_TIME_ZONE = "Asia/Jerusalem"
DORMANT_MIN_QUESTIONS = 5
DORMANT_AFTER_DAYS = 21
FIRST_IMPRESSION_N = 5
EVAL_REGRESSION_THRESHOLD = 0.05

# --- lexicon ---------------------------------------------------------------------------------------------------------
QUOTED_MIN_DISTINCT = 3
DOC_FREQ_MIN = 8
QUERY_FREQ_MAX = 2
QUERY_FREQ_MIN = 5
DOC_FREQ_MAX = 0
MATCH_EVENT_DAYS = 90
USAGE_DAYS = 30

# --- answers ---------------------------------------------------------------------------------------------------------
CACHE_THRESHOLD = 0.92
NEAR_MISS_LOW = 0.82
NEAR_MISS_HIGH = 0.92
NEAR_MISS_LIMIT = 3
REFERENCE_ACCEPT = 70.0
REFERENCE_JACCARD = 0.55
REFERENCE_EXTENSIONS = [".pdf", ".docx", ".doc", ".txt", ".rtf", ".odt"]
META_TITLE = "מאגר הארגון"
REFUSAL_TEXT = (
    "לא נמצאו מקורות מובהקים במסמכים שיתמכו בתשובה מבוססת. "
    "עדיף לפנות לגורם הרלוונטי בארגון מאשר לענות בניחוש."
)
FAILURE_MODES = ["retrieval_miss", "wrong_generation", "other"]
IDEMPOTENCY_KEY_CHARS = 128

# --- Hebrew letters and affixes --------------------------------------------------------------------------------------
FINAL_LETTERS = "ךםןףץ"
MEDIAL_LETTERS = "כמנפצ"
PREFIXES_3 = ["לכש", "מהש", "וכש"]
PREFIXES_2 = [
    "וה", "שה", "מה", "כה", "לה", "וב", "שב", "מב", "כב", "לב", "ול", "של", "מל", "כל",
    "ומ", "שמ", "כמ", "למ", "וכ", "שכ", "מכ", "לכ", "וש", "כש", "מש", "לש", "הו",
]
PREFIXES_1 = ["ה", "ב", "ל", "ו", "מ", "כ", "ש"]
SUFFIXES = [
    "ותיהמ", "ותיהנ", "ותינו", "ותיכמ", "ותיכנ", "יהמ", "יהנ", "המ", "הנ", "כמ", "כנ", "נו", "תי", "תמ", "תנ",
    "יו", "יה", "יכ", "ימ", "ות", "ינו", "מ", "נ", "ה", "ו", "כ", "י", "ת",
]
MIN_STEM = 3
QUERY_STOP_WORDS = [
    "מה", "מי", "האם", "איך", "כמה", "מתי", "איפה", "למה", "אם", "או", "גם", "כי", "כן", "לא", "רק", "עוד", "יש",
    "של", "את", "על", "אל", "עם", "לפי", "לגבי", "בגלל", "זה", "זו", "אלה", "אלו", "הוא", "היא", "הם", "הן",
    "אני", "אתה", "אנחנו", "אתם", "אתן", "קורה", "עושים", "עושה",
    "the", "and", "or", "is", "are", "what", "how",
]
TERM_PREFIXES_1 = ["ה", "ל", "ב", "מ", "ש", "ו", "כ"]
TERM_PREFIXES_2 = ["וה", "לה", "בה", "מה", "שה", "וב", "ול", "ומ"]
TERM_PLURALS = ["ים", "ות"]
MINING_STOP_WORDS = [
    "את", "של", "על", "לא", "כן", "אבל", "אם", "או", "גם", "רק", "יש", "אין", "היה", "היו", "יהיה", "כדי", "לפי",
    "לאחר", "לפני", "בין", "מול", "כמו", "בגלל", "אצל", "שלה", "שלו", "שלנו", "שלכם", "אנחנו", "אתם", "אתה", "אני",
    "הוא", "היא", "הם", "הן", "זה", "זאת", "שם", "פה", "כאן", "מה", "מי", "איך", "למה", "מתי", "איפה", "אחר", "אחת",
    "אחד", "כל", "לכל", "כמה", "יותר", "פחות", "מאוד",
]
MINING_PREFIX_LETTERS = "הלבמשוכ"

# --- decisions ---------------------------------------------------------------------------------------------------------
DECISION_OPENERS = ["הוחלט", "החלטה"]
ESCALATION_PHRASES = [
    "להעביר לאסיפה", "להעביר לקלפי", "להביא לאסיפה", "להביא בפני האסיפה", "יובא לאישור האסיפה",
    "יובא לאישור אסיפה", "יועלה להצבעה", "יעלה להצבעה", "יובא לקלפי", "יועבר לקלפי", "להביא בפני חברי הקיבוץ",
]
TRANSFER_VERBS = [
    "להעביר", "יועבר", "תועבר", "מעביר", "הועבר", "להביא", "יובא", "תובא", "להעלות", "יעלה", "יועלה",
]
HIGHER_FORUM_WORDS = ["אסיפה", "קלפי", "הצבעה"]
UNNUMBERED_OPENERS = ["פרק", "החלטה", "הוחלט", "נוהל", "פרוטוקול"]

# --- questions -----------------------------------------------------------------------------------------------------------
SECTION_WORD = "סעיף"
SUMMARY_PATTERNS = [
    "מה מסופר", "מה מתואר", "תסכם", "סכם לי", "תקציר של", "סיכום של", "על מה דנו", "על מה דובר", "אילו נושאים",
    "מה סדר היום", "במה עוסק", "במה עסק",
]
META_PATTERNS = [
    "כמה מסמכים", "כמה פרוטוקולים", "כמה החלטות", "כמה תקנונים", "המסמך העדכני", "המסמך האחרון",
    "הפרוטוקול האחרון", "ההחלטה האחרונה", "אילו מסמכים יש", "אילו תקנונים קיימים", "אילו תקנונים יש", "מתי הופק",
    "מתי נקלט",
]
DEIXIS_MARKERS = [
    " הם ", " הן ", " זה?", " זה ", " זאת ", "הזה", "הזאת", "ההוא", "ההיא", " אלה", " אלו", "אותו ", "אותה ",
    "אותם ", "שאמרת", "הקודם", "הקודמת", " שלו ", " שלה ", " שלהם ",
]
DISAGREEMENT_MARKERS = ["אבל ", "לא נכון", "לא הבנתי", "אני לא בטוח", "זה לא ", "טעות"]
MIN_TRIAGE_SKIP_WORDS = 6
SELF_CLARIFICATION_MARKERS = [
    "אינה ברורה", "השאלה לא ברורה", "אינה ברורה דיה", "השאלה אינה ברורה דיה", "אנא פרט", "פרט את שאלתך",
    "הכוונה אינה ברורה", "לא ברור לי", "לא ברורה לי", "אנא הבהר",
]
