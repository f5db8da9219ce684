"""Values that must be as they are for right results."""

# Enum members in their declared order, which is their sort order.
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
FINDING_STATUSES = ["OPEN", "IGNORED", "MOVED_TO_PRICING", "AUTO_RESOLVED"]
LEDGER_TYPES = ["BASE_CONTRACT", "APPROVED_VO", "PENDING_VO"]
LEDGER_SOURCES = ["BOQ", "DEKEL", "CUSTOM_ANALYSIS"]
ITEM_TYPES = ["CHAPTER", "SUBCHAPTER", "ITEM"]

# Rates and amounts.
VAT_RATE, OLD_VAT_RATE, DEFAULT_MARKUP_PERCENT = "0.18", "0.17", 15

# Words that make an item's description a note.
NOTE_WORDS = ["הערה", "הערות", "הנחיות", "כללי", "תנאים", "אופן המדידה", "המחיר כולל", "כולל חפירה", "כולל הובלה", "לרבות", "בכפוף"]

# Words of a finding's category.
CONTRADICTION_WORD, CHANGE_WORD, INSTRUCTION_WORD = "סתירה", "שינוי", "הנחיה"

# Classes a finding is shown as.
CONTRADICTION_LABEL, CHANGE_LABEL, SITE_EVENT_LABEL = "סתירה (Contradiction)", "שינוי / הנחיה", "אירוע שטח"

# Words in a document's title, its class and its category; the first match holds.
TITLE_CLASSES = [
    (["כמות", "כמויות", "boq"], "כתב כמויות", "CONTRACT"),
    (["הסכם", "חוזה"], "הסכם", "CONTRACT"),
    (["מפרט"], "מפרט טכני", "CONTRACT"),
    (["פרוטוקול", "סיכום ישיבה"], "פרוטוקול ישיבה", "EXECUTION"),
    (["מחירון", "דקל"], "מחירון", "PRICELIST"),
]
CATEGORY_CLASSES = {"CONTRACT": "מסמך חוזי", "PRICELIST": "מחירון"}
OTHER_CLASS = "מסמך עבודה"

# Headers, labels and total rows of the ledger export.
EXPORT_HEADERS = ["סוג", "סעיף", "תיאור", "יחידה", "כמות", 'מחיר יחידה ללא מע"מ', 'סה"כ ללא מע"מ', "אחוז רווח", 'סכום מע"מ', 'סה"כ כולל מע"מ']
EXPORT_LABELS = {"BASE_CONTRACT": "חוזה בסיס", "APPROVED_VO": "חריג מאושר", "PENDING_VO": "חריג בהמתנה"}
EXPORT_TOTALS = ['סה"כ חוזה בסיס ללא מע"מ', 'סה"כ חריגים ושינויים ללא מע"מ', 'סה"כ הכל ללא מע"מ', 'סה"כ מע"מ', 'סה"כ כולל מע"מ']

# Words of a letter's rows.
CHAPTER_TEXT, SUBCHAPTER_TEXT, NOTE_TEXT = "פרק", "תת-פרק", "הערה"
RATIONALE_PREFIX, EVIDENCE_PREFIX = "הסבר מקצועי (AI): ", "סימוכין חוזי: "
NOTE_KEYS = {"Digital_Twin_Evidence": "ראיות דיגיטליות", "REGULATORY_NOTE": "הערה רגולטורית", "CONTRACTUAL_BASIS": "בסיס חוזי", "MARKET_ANALYSIS": "ניתוח שוק"}
PENDING_VO_PREFIX, NO_DESCRIPTION = "חריג בהמתנה: ", "ללא תיאור"
ATTRIBUTIONS = [r"(?i)\s*Powered by[^\.\n]*", r"\s*מופעל על ידי[^\.\n]*"]
NO_SOURCES, DEFAULT_RATIONALE = "לא צוינו מקורות ספציפיים", "ניתוח אוטומטי של מערכת Gemini"
NO_EVIDENCE, EVIDENCE_DOCUMENT = "אין הוכחות מתועדות", "מסמך"
DEFAULT_TONE = "מקצועי"

# Categories of documents that a scan reads, and the title of a contract without one.
CONTRACT_CATEGORIES, WORK_CATEGORIES, CONTRACT_TITLE = ["CONTRACT", "BOQ", "SPECS"], ["EXECUTION", "SITE_REPORT"], "חוזה"
CONTRACT_TITLE_WORDS = ["חוזה", "הסכם"]

# Headers and total labels of the short export; words of reports, labels and prefilled letters.
SHORT_HEADERS = ["סעיף", "תיאור", "יחידה", "כמות", "מחיר יחידה", 'סה"כ']
SHORT_TOTALS = ['סה"כ (לפני מע"מ)', 'מע"מ ({}%)', 'סה"כ כולל מע"מ']
GENERAL_CLAUSE, SITE_EVENT, SHORT_CHANGE = "כללי", "אירוע שטח", "שינוי/הנחיה"
ACTIVE_LABEL, CLEAN_LABEL, PIECE_UNIT, AREA_UNIT = "פעיל", "נקי", "יח", 'מ"ר'
LETTER_SUBJECT = "הודעה על סתירה/אי-התאמה: "
LETTER_POINTS = ("נמצאה סתירה בין מסמכי החוזה לביצוע:\n", "\n\nנדרשת הנחיה ברורה ותמחור חריג בהתאם לתנאי החוזה.")
