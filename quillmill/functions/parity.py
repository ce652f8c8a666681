"""Patterns and wordings that results have to match: data, kept together and spelled plainly.

Patterns keep to what Java and RE2 read alike. A deployment passes its own where an operator takes them.
"""

from __future__ import annotations

#: Lines that exam papers repeat on every page.
HEADER_LINES = (
    r"GATE\s+\d{4}",
    r"ESE\s+\d{4}",
    r"IES\s+\d{4}",
    r"JEE\s*(?:Main|Advanced)?",
    r"NIT\s+\w+",
    r"IIT\s+\w+",
    r"IISc(?:\s+Bengaluru)?",
    r"Electrical\s+Engineering\s*\(?EE\d*\)?",
    r"Computer\s+Science\s*\(?CS\d*\)?",
    r"Organizing\s+Institute\s*:.*",
)
HEADER_LINE = rf"(?i)^(?:{'|'.join(HEADER_LINES)})\s*$"
PAGE_LINE = r"(?i)^page\s+\d+\s+of\s+\d+\s*$"
#: What marks a page as one of an exam.
EXAM_MARKS = (
    r"UPSC\s+(?:IES|ESE)",
    r"IES\s+\d{4}",
    r"ESE\s+\d{4}",
    r"GATE\s+\d{4}",
    r"JEE.{0,20}(?:Main|Advanced)",
    r"Maximum\s+Marks",
    r"Q\.?\s*\d+\b",
    r"(?:PAPER|PART)\s+[A-Z0-9]\b.*Marks",
)
EXAM = "(?i)" + "|".join(EXAM_MARKS)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: A publisher's boilerplate, in the order of removal: what one pattern takes can put another's line at a line's start.
#: The disclaimer is a block of lines that ends at the portal's address.
BOILERPLATE = (
    r"Department of Health Research\s*\n?",
    r"Ministry of Health and Family Welfare,?\s*Government of India\s*\n?",
    r"Standard Treatment Work\w*\s*\(STW\)[^\n]*\n?",
    rf"(?:{'|'.join(MONTHS)})[/ ]+\d{{4}}\s*\n?",
    r"This STW has been prepared by national experts.*?web portal[^\n]*\(stw\.icmr\.org\.in\)[^\n]*\n?",
    r"© Indian Council of Medical Research[^\n]*\n?",
    r"Kindly visit our web portal[^\n]*\n?",
    r"stw\.icmr\.org\.in\s*\n?",
    r"^\s*\d+\.\s+\d+\.\s+[A-Z][a-z]+[^\n]+\n?",
    r"^\s*\d+\.\s+[A-Z][a-z]+[^\n]+(?:Lancet|European|J Am|Am Fam|pubmed|ncbi|uptodate\.com|doi)[^\n]*\n?",
    r"^\s*\d+\.\s+https?://[^\n]+\n?",
    r"^\s*https?://[^\n]+\n?",
)
#: How a reply begins that talks about the task.
META_OPENINGS = (
    r"unfortunately",
    r"i notice",
    r"it seems",
    r"based on the partial",
    r"the provided description",
    r"the image description you provided",
    r"the description (?:seems|provided|appears)",
    r"the provided content (?:seems|appears)",
    r"i (?:cannot|can't) (?:interpret|read|see)",
    r"(?:here|below) is a (?:cleaned|revised|formatted|corrected|structured)",
    r"i (?:have|'ve) (?:cleaned up|corrected|reformatted|restructured)",
    r"this (?:seems|appears) to be a (?:incomplete|partial|fragmented)",
    r"the (?:content|following) (?:seems|appears) to be (?:incomplete|incorrect|fragmented)",
)
META_OPENER = f"(?i)^(?:{'|'.join(META_OPENINGS)})"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES = ("‘’“”–—", "''\"\"--")
#: Lines in capitals that are no headers of sections.
SLOGANS = (
    "ABBREVIATIONS",
    "ASSESS SWIFTLY, TREAT PRECISELY",
    "BRADYARRHYTHMIA MANAGEMENT: RESTORING LIFE'S NATURAL RHYTHM",
    "KEEP A HIGH THRESHOLD FOR INVASIVE PROCEDURES",
    "LISTEN TO YOUR HEART",
    "LISTEN TO YOUR HEART: PREDICTABLE PAIN NEEDS PREDICTABLE CARE",
    "MISSION: LIFELINE",
    "MONITOR, MANAGE, AND MAINTAIN HEART HEALTH",
    "MULTIDISCIPLINARY CARE",
    "RESTORING RHYTHM, RESTORING FREEDOM",
)
NO_HEADERS = ("ECG: SINUS BRADYCARDIA", "ECG: THIRD DEGREE HEART BLOCK", "INDEX/ KEY", "LEGEND", "LEGEND/ INDEX/ KEY", "LEGEND/INDEX/KEY", "REFERENCES")
ABBREVIATION = r"^[A-Z]{2,8}:\s+[A-Z][a-z]"
DOSE = r"(?i)\d+\s*[–-]?\s*\d*\s*(?:MEQ|MCG|MG|ML|UNITS|U/KG)"
TABLES_MARK = "<!-- TABLES: structured form of page content — use these, remove any duplicate prose above -->"
TABLES_INTRO = "> The following tables are extracted directly from the PDF and contain structured clinical data including drug dosages, scoring systems, and management protocols."
NO_JUDGE = "*Vision judge did not run — text-only extraction.*"
