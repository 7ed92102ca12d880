"""The deterministic rules, field labels and figure labels of the domain."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    pii_type: str
    pattern: str
    confidence: float
    validator: str = ""
    cues: tuple[str, ...] = ()
    context_required: bool = False
    review_unless_context: bool = False
    money_guard: bool = False
    case_sensitive: bool = False


# Patterns, base confidences, validators and context cues.
RULES = [
    Rule("ssn_dashed", "SSN", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", 0.97, validator="ssn", cues=("ssn", "social", "security", "taxpayer", "employee", "tin",)),
    Rule("ssn_spaced", "SSN", r"(?<![\d])\d{3}\s\d{2}\s\d{4}(?![\d])", 0.85, validator="ssn", cues=("ssn", "social", "security", "taxpayer",)),
    Rule("ssn_plain_unlabelled", "SSN", r"(?<![\d\-])\d{9}(?![\d\-])", 0.6, validator="ssn", review_unless_context=True),
    Rule("ssn_plain", "SSN", r"(?<![\d\-])\d{9}(?![\d\-])", 0.82, validator="ssn", cues=("ssn", "social", "security", "taxpayer", "employee", "tin", "identification",), context_required=True),
    Rule("itin", "ITIN", r"(?<![\d-])9\d{2}-[7-9]\d-\d{4}(?![\d-])", 0.95),
    Rule("ein", "EIN", r"(?<![\d-])\d{2}-\d{7}(?![\d-])", 0.9, validator="ein"),
    Rule("ein_spaced", "EIN", r"(?<![\d])\d{2}\s\d{7}(?![\d])", 0.75, validator="ein", cues=("ein", "employer", "federal", "tax id", "identification",)),
    Rule("ip_pin", "IP_PIN", r"(?<![\d])\d{6}(?![\d])", 0.8, cues=("ip pin", "identity protection",), context_required=True),
    Rule("email", "EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0.98),
    Rule("phone_us", "PHONE", r"(?<![\d\-])(?:\+?1[\s.\-]?)?(?:\(\d{3}\)[\s.\-]?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?![\d])", 0.9, money_guard=True),
    Rule("routing_aba", "ROUTING_NUMBER", r"(?<![\d])\d{9}(?![\d])", 0.75, validator="aba", cues=("routing", "aba", "rtn", "transit",)),
    Rule("bank_account", "BANK_ACCOUNT", r"(?<![\d])\d{7,17}(?![\d])", 0.7, cues=("account", "acct", "checking", "savings", "brokerage", "deposit", "iban",), context_required=True, money_guard=True),
    Rule("card_number", "CARD_NUMBER", r"(?<![\d])(?:\d[ \-]?){13,19}(?![\d])", 0.9, validator="luhn", money_guard=True),
    Rule("iban", "IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.9),
    Rule("swift_bic", "SWIFT_BIC", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.7, cues=("swift", "bic",), context_required=True),
    Rule("ipv4", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.85),
    Rule("mac", "MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.95),
    Rule("uuid", "UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 0.95),
    Rule("us_zip", "POSTAL_CODE", r"(?<![\d\-])\d{5}(?:-\d{4})?(?![\d\-])", 0.55, cues=("zip", "postal", "address", "city", "state",), review_unless_context=True, money_guard=True),
    Rule("city_state_zip", "ADDRESS", r"\b[A-Z][A-Za-z.\- ]{1,28}(?:,\s*(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)\.?(?:\s+\d{5}(?:-\d{4})?)?|\s+(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)\.?\s+\d{5}(?:-\d{4})?)\b", 0.85, case_sensitive=True),
    Rule("street_address", "STREET", r"\b\d{1,6}\s+[A-Z0-9][A-Za-z0-9.\- ]{2,40}\s(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Wy|Circle|Cir|Place|Pl|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Suite|Ste|Unit|Apt|Common|Cmn|Trail|Trl|Crossing|Xing|Loop|Path|Run|Point|Pt|Pointe|Ridge|Rdg|Glen|Gln|Grove|Grv|Meadow|Mdws|Crescent|Cres|Bend|Bnd|Cove|Cv|Landing|Lndg|Pass|Walk|Row|Alley|Aly|Square|Sq|Close|Vista|Bluff|Blf|Chase|Corner|Cor|Estates|Est|Gardens|Gdns|Heights|Hts|Hollow|Holw|Junction|Jct|Mill|Mnr|Manor|Orchard|Orch|Plaza|Plz|Ridge|Summit|Smt|Valley|Vly|View|Vw|Village|Vlg|Wells)\b\.?", 0.85),
    Rule("po_box", "PO_BOX", r"\bP\.?\s?O\.?\s?Box\s+\d+\b", 0.9),
    Rule("dob", "DOB", r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", 0.8, cues=("birth", "dob", "born", "d.o.b",), context_required=True),
    Rule("drivers_license", "DRIVERS_LICENSE", r"\b[A-Z]\d{7,12}\b", 0.75, cues=("driver", "license", "licence", "dl no", "state id",), context_required=True),
    Rule("passport", "PASSPORT", r"\b(?=[A-Z0-9]*\d)[A-Z0-9]{6,9}\b", 0.75, cues=("passport",), context_required=True),
    Rule("policy_number", "POLICY_NUMBER", r"\b(?=[A-Z0-9\-]*\d)[A-Z0-9][A-Z0-9\-]{4,19}\b", 0.7, cues=("policy no", "policy number", "policy #", "contract number",), context_required=True),
    Rule("member_id", "MEMBER_ID", r"\b(?=[A-Z0-9\-]*\d)[A-Z0-9][A-Z0-9\-]{4,19}\b", 0.7, cues=("member id", "subscriber id", "health plan", "group number",), context_required=True),
    Rule("mrn", "MRN", r"\b[A-Z0-9\-]{5,15}\b", 0.7, cues=("medical record", "mrn", "patient id", "chart number",), context_required=True),
    Rule("claim_number", "CLAIM_NUMBER", r"\b[A-Z0-9][A-Z0-9\-]{4,19}\b", 0.7, cues=("claim number", "claim no", "claim #",), context_required=True),
    Rule("case_number", "CASE_NUMBER", r"\b[0-9]{1,4}[:\-][A-Za-z0-9\-]{3,20}\b", 0.75, cues=("case", "docket", "matter",), context_required=True),
    Rule("employee_id", "EMPLOYEE_ID", r"\b[A-Z]{0,3}\d{4,10}\b", 0.7, cues=("employee id", "employee no", "personnel", "badge", "payroll id", "emp #",), context_required=True),
    Rule("customer_id", "CUSTOMER_ID", r"\b[A-Z0-9][A-Z0-9\-]{3,19}\b", 0.65, cues=("customer id", "client id", "customer no", "client no", "account id",), context_required=True),
    Rule("username", "USERNAME", r"(?<![\w@])@[A-Za-z0-9_]{3,30}\b", 0.7, cues=("username", "user name", "handle", "twitter", "instagram", "login",)),
    Rule("medicare_mbi", "MEDICARE_ID", r"(?<![A-Za-z0-9])[1-9][ACDEFGHJKMNPQRTUVWXY][A-Z0-9]\d[ACDEFGHJKMNPQRTUVWXY][A-Z0-9]\d[ACDEFGHJKMNPQRTUVWXY]{2}\d{2}(?![A-Za-z0-9])", 0.75),
    Rule("social_handle", "SOCIAL_HANDLE", r"(?<![A-Za-z0-9_@])@[A-Za-z0-9_]{3,30}(?![A-Za-z0-9_])", 0.5, cues=("instagram", "twitter", "handle", "username", "follow", "social", "tiktok",), context_required=True),
    Rule("fax_number", "FAX", r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)", 0.6, cues=("fax", "facsimile",), context_required=True),
]

# What a field label announces.
LABELS = [
    (r"name[, ]+address[, ]*(and)?[ ]*(zip|postal)( code)?", ["PERSON", "ADDRESS", "POSTAL_CODE"]),
    (r"name[, ]+(and )?address", ["PERSON", "ADDRESS"]),
    (r"(responsible party|authorized signer|managing member|general partner|trustee|executor|fiduciary|beneficiary|principal officer|policyholder|policy owner|named insured|primary insured|subscriber|plan participant|recipient|payee|annuitant|grantor|settlor|decedent|ward|next of kin|contract holder|account owner|policy holder)", ["PERSON"]),
    (r"(taxpayer|spouse|employee|client|customer|patient|member|insured|owner|shareholder|partner|applicant|borrower|guarantor)?\s*(full |legal |first |last |middle |maiden |preferred )?name", ["PERSON"]),
    (r"(spouse|co-?applicant|co-?borrower|co-?signer|dependent|child|son|daughter|parent|mother|father|guardian|(paid )?preparer|contact( person)?|emergency contact|signatory|witness|attorney|representative|claimant|heir)", ["PERSON"]),
    (r"(mailing |home |business |street |residential |permanent |previous |registered |principal )?address", ["ADDRESS"]),
    (r"(city|town)[, ]*(state)?[, ]*(zip|postal)?( code)?", ["ADDRESS"]),
    (r"(zip|postal)( code)?", ["POSTAL_CODE"]),
    (r"(ssn|social security( number| no\.?| #)?)", ["SSN"]),
    (r"(ein|employer identification( number| no\.?)?|federal (tax )?id)", ["EIN"]),
    (r"(itin|individual taxpayer identification)", ["ITIN"]),
    (r"(tin|taxpayer (identification|id)( number)?|tax id( number)?)", ["TIN"]),
    (r"((business|company|entity|trade|dba|doing business as|legal|firm|employer|payer|payee|partnership|corporation|llc)(['’]s)? name)", ["ORG_PRIVATE"]),
    (r"(name of (business|company|entity|employer|partnership|corporation|firm))", ["ORG_PRIVATE"]),
    (r"(e-?mail( address)?)", ["EMAIL"]),
    (r"(phone|telephone|mobile|cell|fax)( number| no\.?| #)?", ["PHONE"]),
    (r"(date of birth|birth date|dob|d\.o\.b\.?|born on)", ["DOB"]),
    (r"((country|countries) of )?(citizenship|nationality|citizen of)", ["CITIZENSHIP"]),
    (r"(place|city|country) of birth|birthplace|born in", ["BIRTHPLACE"]),
    (r"(sex|gender)", ["GENDER"]),
    (r"(bank|checking|savings|brokerage|investment|retirement|deposit)?\s*account( number| no\.?| #)?", ["BANK_ACCOUNT"]),
    (r"(routing( number| no\.?| #)?|aba( number)?)", ["ROUTING_NUMBER"]),
    (r"(policy)( number| no\.?| #)?", ["POLICY_NUMBER"]),
    (r"(member|subscriber|patient) id", ["MEMBER_ID"]),
    (r"(employee|personnel|payroll|badge) (id|number|no\.?|#)", ["EMPLOYEE_ID"]),
    (r"(driver.?s? licen[cs]e|state id)( number| no\.?| #)?", ["DRIVERS_LICENSE"]),
    (r"passport( number| no\.?| #)?", ["PASSPORT"]),
    (r"(case|docket|matter|file)( number| no\.?| #)", ["CASE_NUMBER"]),
    (r"(marital status|filing status)", ["MARITAL_STATUS"]),
    (r"(account|acct)[\s.]*(number|no\.?|#|id)", ["ACCOUNT_ID"]),
    (r"(matter|docket|case file)[\s.]*(number|no\.?|#|id)", ["MATTER_ID"]),
    (r"(payroll|badge)[\s.]*(number|no\.?|#|id)", ["PAYROLL_ID"]),
    (r"(state tax id|state (id|identification)( number)?)", ["STATE_TAX_ID"]),
    (r"(medicare( beneficiary)?( id| number)?|mbi)", ["MEDICARE_ID"]),
    (r"(personal (website|url|blog|page)|your (website|url))", ["URL_PERSONAL"]),
]

# Labels of figures, whose values are never personal.
FIGURE_LABELS = [
    r"(gross |net |annual |monthly |total |taxable |adjusted )?(wages|salary|income|revenue|receipts|compensation|earnings|pay)",
    r"(total|subtotal|balance|amount|amount due|amount owed|payment|refund|credit|debit)",
    r"(federal|state|local|income|payroll|self-?employment)? ?(tax|taxes|withholding|withheld|liability)",
    r"(deduction|deductions|expense|expenses|contribution|contributions|distribution|basis|depreciation)",
    r"(rate|percentage|percent|apr|yield|allocation)",
    r"(tax year|year|period|quarter|form|schedule|line|page|part|section|box)( number| no\.?| #)?",
    r"(units|shares|quantity|count|hours)",
    r"(occupation|job title|profession|filing status|status|marital status)",
]

# Score from which a value of a type is confirmed, and from which it is probable.
THRESHOLDS = {
    "SSN": (0.55, 0.4),
    "EIN": (0.55, 0.4),
    "ITIN": (0.55, 0.4),
    "TIN": (0.55, 0.4),
    "IBAN": (0.55, 0.4),
    "CARD_NUMBER": (0.55, 0.4),
    "ROUTING_NUMBER": (0.6, 0.45),
    "SWIFT_BIC": (0.6, 0.45),
    "UUID": (0.6, 0.45),
    "IP_ADDRESS": (0.6, 0.45),
    "MAC_ADDRESS": (0.6, 0.45),
    "EMAIL": (0.6, 0.45),
    "PHONE": (0.6, 0.45),
    "DOB": (0.65, 0.5),
    "PERSONAL_DATE": (0.65, 0.5),
    "PERSON": (0.68, 0.5),
    "ORG_PRIVATE": (0.68, 0.5),
    "ADDRESS": (0.65, 0.5),
    "STREET": (0.65, 0.5),
    "CITY_STATE": (0.65, 0.5),
    "POSTAL_CODE": (0.6, 0.45),
}
OTHER_THRESHOLDS = (0.65, 0.45)

# Words that no personal name contains.
FORM_WORDS = [
    "here",
    "mail",
    "with",
    "detach",
    "page",
    "form",
    "cut",
    "fold",
    "along",
    "line",
    "dotted",
    "tear",
    "staple",
    "clip",
    "ira",
    "iras",
    "nondeductible",
    "rollover",
    "contribution",
    "distribution",
    "beneficiary",
    "traditional",
    "roth",
    "schedule",
    "department",
    "treasury",
    "internal",
    "revenue",
    "service",
    "attachment",
    "sequence",
    "omb",
    "copy",
    "part",
    "section",
    "total",
    "subtotal",
    "amount",
    "balance",
    "due",
    "paid",
    "tax",
    "taxes",
    "income",
    "wages",
    "salary",
    "gross",
    "net",
    "adjusted",
    "taxable",
    "deduction",
    "deductions",
    "credit",
    "credits",
    "refund",
    "withholding",
    "employer",
    "employee",
    "name",
    "address",
    "city",
    "state",
    "zip",
    "code",
    "number",
    "date",
    "signature",
    "title",
    "single",
    "married",
    "filing",
    "jointly",
    "separately",
    "household",
    "widow",
    "widower",
    "yes",
    "no",
    "none",
    "see",
    "instructions",
    "check",
    "box",
    "if",
    "and",
    "or",
    "the",
    "of",
    "for",
    "from",
    "this",
    "that",
    "continued",
    "important",
    "notice",
    "statement",
    "summary",
    "detail",
    "account",
    "type",
    "description",
    "quantity",
    "rate",
    "percent",
    "daytime",
    "evening",
    "home",
    "work",
    "mobile",
    "cell",
    "phone",
    "email",
    "fax",
    "routing",
    "bank",
    "preparer",
    "occupation",
    "engineer",
    "manager",
    "analyst",
    "director",
    "officer",
    "consultant",
    "attorney",
    "accountant",
    "taxpayer",
    "spouse",
    "filer",
    "ssn",
    "ein",
    "itin",
    "tin",
    "ptin",
    "social",
    "security",
    "identification",
    "need",
    "to",
    "keep",
    "have",
    "has",
    "had",
    "will",
    "would",
    "should",
    "could",
    "can",
    "may",
    "might",
    "must",
    "is",
    "are",
    "was",
    "were",
    "be",
    "been",
    "being",
    "do",
    "does",
    "did",
    "make",
    "made",
    "get",
    "got",
    "go",
    "went",
    "come",
    "came",
    "take",
    "took",
    "give",
    "gave",
    "want",
    "please",
    "note",
    "notes",
    "overview",
    "reminder",
    "action",
    "required",
    "pending",
    "next",
    "prior",
    "current",
    "previous",
    "review",
    "reviewed",
    "confirm",
    "confirmed",
    "pay",
    "payment",
    "estimated",
    "return",
    "corporation",
    "company",
    "inc",
    "llc",
    "llp",
    "ltd",
    "trust",
    "estate",
    "partnership",
    "national",
    "association",
    "federal",
    "united",
    "states",
    "america",
    "clinic",
    "hospital",
    "center",
    "centre",
    "university",
    "college",
    "school",
    "church",
    "foundation",
    "institute",
    "agency",
    "office",
    "services",
    "county",
    "district",
    "authority",
    "board",
    "commission",
    "committee",
    "council",
    "campaign",
    "election",
    "presidential",
    "fund",
    "program",
    "programme",
    "insurance",
    "health",
    "medical",
    "community",
    "society",
    "report",
    "worksheet",
    "only",
    "use",
]

# Families of business figures, as (kind, reason, pattern).
CURRENCY = r"(?:[$€£¥₹₩₽₪₫฿]|(?:USD|EUR|GBP|CAD|AUD|JPY|CNY|INR|CHF|MXN|NZD|SEK|NOK|DKK|HKD|SGD)(?![A-Za-z]))"
FIGURES = [
    ("money", "currency amount", rf"\(?-?\s?{CURRENCY}\s?\d[\d,]*(?:\.\d+)?\s?\)?|\d[\d,]*(?:\.\d+)?\s?{CURRENCY}(?![\w])"),
    ("money", "amount with thousands separators", r"(?<![\w.,/])\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?(?![\w,])"),
    ("money", "decimal amount", r"(?<![\w.,/])\(?-?\d+\.\d{2}\)?(?![\w.])"),
    ("percent", "percentage", r"(?<![\w.])-?\d+(?:\.\d+)?\s?%"),
    ("tax_year", "tax year", r"(?<![\w./,\-])(?:19|20)\d{2}(?![\w/\-])"),
    ("line_number", "line number", r"(?i)\b(?:lines?|ln\.?)\s+\d{1,3}[a-z]?(?:\([a-z0-9]\))?(?![\w])"),
    ("form_number", "form or schedule reference",
     r"(?i)\b(?:forms?|schedules?|sch\.?|pub(?:lication)?\.?|notice)\s+"
     r"(?:(?-i:[A-Z]{1,3})-?\d{1,4}(?-i:[A-Z])?(?:-(?-i:[A-Z]{1,3}))?|\d{3,4}(?:-?(?-i:[A-Z]{1,3}))?|(?-i:[A-Z]{1,2})\b)"),
    ("form_number", "tax form number",
     r"(?i)(?<![\w./,\-])(?:1040(?:-?(?:SR|NR|X|ES))?|1065|1120(?:-?S)?|1099(?:-?[A-Z]{2,5})?|"
     r"941(?:-?X)?|940|W-?[2-9]|SS-?4|8832|2553|4868|7004|8949|8962)(?![\w/\-])"),
    ("form_number", "page number", r"(?i)\bpage\s+\d+(?:\s+of\s+\d+)?(?![\w])"),
]

# Types made of digits, what a form holds where it names nobody, and the types that satisfy an expected one.
DIGIT_TYPES = [
    "SSN", "EIN", "ITIN", "TIN", "STATE_TAX_ID", "BANK_ACCOUNT", "ROUTING_NUMBER", "PHONE", "FAX", "POSTAL_CODE", "DOB", "PERSONAL_DATE", "CARD_NUMBER",
    "MEDICARE_ID", "IP_PIN", "PTIN",
]
PLACEHOLDERS = [
    "self-prepared", "self prepared", "self", "n/a", "na", "n.a.", "none", "same", "same as above", "see attached", "see statement", "see stmt", "various",
    "not applicable", "unknown", "applied for", "-", "--", "—", "x", "xx", "xxx", "on file", "declined", "withheld",
]
SATISFIED_BY = {
    "ADDRESS": ["ADDRESS", "STREET", "CITY_STATE", "PO_BOX", "POSTAL_CODE"],
    "POSTAL_CODE": ["POSTAL_CODE", "ADDRESS"],
    "PERSON": ["PERSON"],
    "TIN": ["TIN", "SSN", "EIN", "ITIN"],
}
# Types that describe one thing and do not contradict each other.
COMPATIBLE = [
    ["ADDRESS", "STREET", "CITY_STATE", "PO_BOX", "POSTAL_CODE"],
    ["TIN", "SSN", "EIN", "ITIN"],
    ["PHONE", "FAX"],
    ["ACCOUNT_ID", "CUSTOMER_ID", "MEMBER_ID"],
]
# Types whose rules are strong evidence by themselves.
STRONG_TYPES = ["SSN", "ITIN", "EIN", "TIN", "IP_PIN", "EMAIL", "PHONE", "CARD_NUMBER", "IBAN", "ROUTING_NUMBER"]
# Types whose values may be figures, and those that a figure is never cut out of.
FIGURE_WAIVER = [
    "SSN", "ITIN", "EIN", "TIN", "IP_PIN", "STATE_TAX_ID", "POSTAL_CODE", "BANK_ACCOUNT", "ROUTING_NUMBER", "CARD_NUMBER", "EMPLOYEE_ID", "PAYROLL_ID",
    "MEDICARE_ID", "POLICY_NUMBER", "MEMBER_ID", "MRN", "CLAIM_NUMBER", "CASE_NUMBER", "MATTER_ID", "CUSTOMER_ID", "ACCOUNT_ID", "DRIVERS_LICENSE", "PASSPORT",
    "DOB", "PERSONAL_DATE",
]
FIGURE_CLIP_EXEMPT = [*FIGURE_WAIVER, "ADDRESS", "STREET", "CITY_STATE"]
