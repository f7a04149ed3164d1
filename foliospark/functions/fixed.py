"""Values that results depend on, stated as they are.  Everything here can be replaced by a parameter."""

# Topics and the patterns (any case) that give them, in menu order.
TOPICS = {
    "wages": [r"\bwage(s)?\b", r"\bsalar(y|ies)\b", r"\bgeneral wage increase\b", r"\bcompensation\b", r"\brates? of pay\b"],
    "longevity": [r"\blongevity\b", r"\blongevity differential\b", r"\bservice increment\b"],
    "overtime": [r"\bovertime\b", r"\bO\.?T\.?\b", r"\btime and one[- ]half\b", r"\bcompensatory time\b"],
    "holidays": [r"\bholiday(s)?\b", r"\bobserved holiday\b"],
    "vacation": [r"\bvacation\b", r"\bannual leave\b"],
    "sick-leave": [r"\bsick (leave|day|time|pay)\b", r"\bsick bank\b"],
    "parental-leave": [r"\bparental leave\b", r"\bmaternity\b", r"\bpaternity\b", r"\bchild[-\s]?bonding\b", r"\bfamily leave\b"],
    "other-leave": [r"\bjury duty\b", r"\bbereavement\b", r"\bmilitary leave\b", r"\bunpaid leave\b"],
    "health-welfare": [r"\bhealth\s+(insurance|benefits|plan)\b", r"\bwelfare fund\b", r"\bhealth and welfare\b", r"\bmedical benefits\b"],
    "pension": [r"\bpension\b", r"\bretirement\b", r"\bNYCERS\b", r"\bTRS\b", r"\bdeferred compensation\b"],
    "grievance": [r"\bgrievance\b", r"\barbitration\b", r"\bstep [1-4]\b"],
    "discipline": [r"\bdiscipline\b", r"\bdisciplinar(y|y action)\b", r"\btermination\b", r"\bdischarg(e|ed)\b", r"\bjust cause\b", r"\bsection 75\b", r"\bcounseling memo(randum)?\b"],
    "layoff": [r"\blayoff\b", r"\breduction in force\b", r"\bRIF\b", r"\bbump(ing)?\b", r"\bseniority\b"],
    "hours": [r"\bwork(ing)? hours\b", r"\bwork day\b", r"\bwork week\b", r"\bschedul(e|ing)\b", r"\btour\b", r"\bshift\b"],
    "shift-differential": [r"\bshift differential\b", r"\bnight (shift )?differential\b"],
    "uniform-allowance": [r"\buniform allowance\b", r"\buniform maintenance\b", r"\bequipment allowance\b"],
    "training": [r"\btraining\b", r"\beducation reimbursement\b", r"\btuition\b"],
    "safety": [r"\bsafety\b", r"\bhealth and safety\b", r"\bunsafe\b", r"\binjur(y|ies)\b", r"\bworkers'? compensation\b"],
    "no-strike": [r"\bno[- ]strike\b", r"\bstrike\b", r"\bwork stoppage\b"],
    "management-rights": [r"\bmanagement (rights|prerogatives?)\b"],
    "work-rules": [r"\bwork rules?\b", r"\bpersonnel rules\b"],
    "agency-shop": [r"\bagency (fee|shop)\b", r"\bdues check[- ]?off\b", r"\bdues deduction\b", r"\bunion (membership|security)\b"],
    "recognition": [r"\brecognition\b", r"\bbargaining unit\b", r"\bcertif(y|ication|ied) representative\b"],
    "promotion": [r"\bpromotion\b", r"\bcivil service\b", r"\beligible list\b"],
    "telework": [r"\btelework\b", r"\bremote work\b", r"\btelecommut\b", r"\bflexible work\b"],
    "diversity": [r"\bdiscrimination\b", r"\bharassment\b", r"\bequal (employment )?opportunity\b", r"\bDEI\b"],
    "workforce-comp": [r"\bworkforce composition\b", r"\bcomp(osition|liance) of (the )?workforce\b"],
}

# Characters of a clause that the tagger reads.
TAG_CHARS = 5000

# Sector rules on a lower-cased label, first match wins.
SECTORS = [
    (r"\bpolice\b|\bpba\b|\bsba\b|\bdea\b|\blba\b|\bcea\b|sergeants?|detectives?|lieutenants?|captains?", "uniformed-police"),
    (r"\bfire\b|\bufa\b|\bufoa\b|firefighters?|fire officers?", "uniformed-fire"),
    (r"\bsanitation\b|\bdsna\b|\busa\b|\busca\b|\busa-", "uniformed-sanitation"),
    (r"\bcorrection\b|\bcoba\b|\badwa\b|\bcoba\b|\badba\b", "uniformed-correction"),
    (r"\bteacher\b|\buft\b|\bcsa\b|\bcsba\b|principal|school", "education"),
    (r"\bdoctor|physician|dental|nurse|hospital|medical|health|1199|doctors council", "health"),
    (r"\binspector\b|\bdetective\b|investigat", "professional"),
    (r"electrician|carpenter|plumber|painter|machinist|mechanic|welder|engineer|trades?|steamfitter|boilermaker|locksmith|blacksmith|laborer|repairer|fitter|operator|crane|gasoline|sheet metal|sign|rigger|dockbuilder|ship", "skilled-trades"),
    (r"\battorney\b|\blawyer\b|\bale\b|legislative", "professional"),
    (r"\bdc37\b|\bdc 37\b|\bdistrict council 37\b|\blocal 37\b|\blocal 372\b|\blocal 1549\b|\blocal 983\b", "clerical-and-professional"),
    (r"administrative manager|administrative associate|cwa 1180|supervisory|managerial|managers", "supervisory-clerical"),
]

# Heading lines.
ARTICLE_LINE = r"^(?:ARTICLE|Article)\s+([IVXLC]+|\d+)(?:[\.:\-\s]+(.+?))?\s*$"
SECTION_LINE = r"^(?:SECTION|Section|Sec\.)\s+(\d+(?:\.\d+)?)(?:[\.:\-\s]+(.+?))?\s*$"
NUMBERED_LINE = r"^(\d+)\.\s+([A-Z][A-Z &/'\-]{4,}?)\s*$"
CAPITALS_LINE = r"^([A-Z][A-Z 0-9&'/\-]{4,}?)\s*$"

# Wordings that mark a document as amending, as a determination or as a unit letter.
AMENDS = (
    r"(?i)(terms?\s+of\s+the\s+predecessor[^.]{0,120}?(?:continued|remain)"
    r"|predecessor\s+(?:separate\s+)?unit\s+agreement[^.]{0,120}?continued"
    r"|all\s+other\s+terms[^.]{0,120}?(?:remain|continue)"
    r"|shall\s+be\s+continued\s+except\s+as\s+modified"
    r"|shall\s+continue\s+as\s+modified\s+by"
    r"|remain\s+in\s+full\s+force\s+and\s+effect\s+except"
    r"|except\s+as\s+(?:modified|amended|changed)\s+(?:herein|by\s+this))"
)
CONSENT = r"(?i)(consent\s+determination|wage\s+indenture|comptroller\s+of\s+the\s+city\s+of\s+new\s+york|labor\s+law\s+section\s+220|section\s+220\.8)"
UNIT_LETTER = r"(?i)(unit\s+bargaining|uniform(?:ed)?\s+officers?\s+coalition|\bUOCEA\b|\bVOCEA\b)"

# Wordings at the beginning of documents, articles in texts and headings, and how far and how many are looked at.
INDENTURE = r"\bINDENTURE\b"
MEMORANDUM = r"(?i)memorandum\s+of\s+(?:economic\s+)?agreement"
NO_MEMORANDUM = r"(?i)before\s+the\s+comptroller|consent\s+determination"
EXECUTED = r"(?i)executed\s+contract"
CONSENT_LABELS = ("consent determination", "wage indenture")
ARTICLE_IN_TEXT = r"(?im)^\s*ARTICLE\s+(?:[IVXLC]+|\d+)\b"
ARTICLE_HEADING = r"(?i)^\s*Article\s+(?:[IVXLC]+|\d+)\b"
HEAD_CHARS, WORDING_CHARS, EXECUTED_CHARS, FULL_CHARS, EVIDENCE_CHARS = 700, 6000, 3000, 40000, 180
EXECUTED_ARTICLES, MANY_ARTICLES, SOME_ARTICLES = 12, 8, 4

# Letter confusions of character recognition, (read, meant).
CONFUSIONS = [("v", "y"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("c", "e"), ("e", "c"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("ii", "n"), ("n", "ii"), ("li", "h"), ("h", "li"), ("ti", "ii"), ("ii", "ti")]

# Letters that recognition drops most.
DROPPED_LETTERS = "aeioulmnrstdh"

# Months in the two styles that reports use.
MONTHS_AP = ["Jan.", "Feb.", "March", "April", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]
MONTHS_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTHS_LONG = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# Words that mark a short heading on a link page as a section.
SECTION_WORDS = r"(?i)agreement|citywide|uniformed|education|economic|coalition|trade|skilled|welfare|board"

# What ends a sentence, and lines of a table of numbers.
SENTENCE_ENDS = ".!?\"'’)"
NUMBERS_LINE = r"^[\d$.,\-•*\s]+$"

# Percentages and lump sums in running text.
PERCENTS = r"(\d{1,2}\.\d{1,2})\s*%"
LUMP_SUMS = r"(?i)\$\s?([\d,]{3,7})\s*(?:lump sum|ratification|bonus|payment|cash)"

# Report order and titles of document status.
STATUS_ORDER = ["superseded", "continued", "expired", "expiring", "current", "unknown"]

#: Badges of recognised documents by their quality.
OCR_BADGES = {"poor": "heavy OCR errors", "fair": "some OCR errors"}
