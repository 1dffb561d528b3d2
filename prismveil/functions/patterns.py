"""Patterns of the detection pass, in order of precedence.

Fixed values: the patterns and word lists below decide which characters are claimed, so they
are stated as they must be.  They are compiled with ASCII classes (``\\b``, ``\\w``, ``\\d``).
"""

from __future__ import annotations

import re

# ---- fixed values: pieces ----------------------------------------------------------------

_SEP = r"\s{0,3}(?:[:#=]\s{0,3})?(?:(?:[Nn]o\.?|[Nn]umber|#)\s{0,3}[:#]?\s{0,3})?"
_ID_VALUE = r"([A-Za-z]{0,4}-?\d[\dA-Za-z]{2,15}(?:-\d{1,6})?)(?![\w-])"
_EDGE = r"(?<![A-Za-z0-9])"
_NO = r"(?:ID|#|[Nn]o\.?|[Nn]umber)"
_MRN = (
    r"(?:[Mm]edical\s[Rr]ecord(?:\s(?:[Nn]umber|[Nn]o\.?|#))?|[Mm]ed\.?\s?[Rr]ec\.?|MRN|MR#|[Pp]atient\s(?:ID|[Nn]umber|[Nn]o\.?|#)|"
    r"[Pp]t\.?\s?(?:ID|#)|PID|[Cc]hart\s?(?:#|[Nn]o\.?|[Nn]umber)|CSN|FIN|[Ee]ncounter\s?" + _NO + r"|[Vv]isit\s?" + _NO + r"|"
    r"[Aa]ccession\s?(?:#|[Nn]o\.?|[Nn]umber)?)"
)
_ACCOUNT = (
    r"(?:[Aa]ccount\s?(?:#|[Nn]o\.?|[Nn]umber)|[Aa]cct\.?|HAR|[Cc]laim\s?" + _NO + r"|(?:[Pp]rior\s)?[Aa]uth(?:orization)?\s?(?:#|[Nn]o\.?|[Nn]umber)|"
    r"[Rr]ef(?:erence)?\s?(?:#|[Nn]o\.?|[Nn]umber))"
)
_PLAN = (
    r"(?:[Mm]ember\s?" + _NO + r"|[Ss]ubscriber\s?" + _NO + r"|[Pp]olicy\s?" + _NO + r"|[Ii]nsurance\s" + _NO + r"|[Mm]edicaid(?:\s" + _NO + r")?|CIN|R[Xx]\s?ID|"
    r"[Bb]eneficiary\s" + _NO + r"|[Pp]lan\sID)"
)
_LICENSE = r"(?:[Dd]river'?s\s[Ll]icen[cs]e(?:\s(?:#|[Nn]o\.?|[Nn]umber))?|[Ll]icen[cs]e\s?(?:#|[Nn]o\.?|[Nn]umber)|[Ll]ic\.?\s?(?:#|[Nn]o\.?)|DL\s?#)"
_SOCIAL = r"(?:SSN|SS#|[Ss]ocial\s[Ss]ecurity(?:\s[Nn]umber)?)"
_LAST4 = r"[Ll]ast\s(?:4|[Ff]our)(?:\s[Dd]igits)?"
_SSN_PARTIAL = (
    r"(?:" + _EDGE + _SOCIAL + r"\s{0,3}(?:#|[Nn]o\.?)?\s{0,3}:?\s{0,3}(?:[Ee]nding(?:\s[Ii]n)?|" + _LAST4 + r"|[Xx*]{3}-?[Xx*]{2}-?)\s{0,3}:?\s{0,3}|"
    + _EDGE + _LAST4 + r"\sof\s(?:(?:his|her|their|the|[Pp]t'?s|[Pp]atient'?s)\s){0,2}" + _SOCIAL + r"\s{0,3}(?:is\s)?:?\s{0,3}|"
    + _EDGE + r"(?:[Xx]{3}|\*{3})-(?:[Xx]{2}|\*{2})-)(\d{4})(?!\d)"
)
_MBI_A, _MBI_AN = "[AC-HJKMNP-RT-Y]", "[AC-HJKMNP-RT-Y0-9]"
_MBI = r"(?<![A-Za-z0-9-])[1-9]" + _MBI_A + _MBI_AN + r"\d-?" + _MBI_A + _MBI_AN + r"\d-?" + _MBI_A + _MBI_A + r"\d\d(?![A-Za-z0-9-])"
_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR GU VI AS MP"
_STATE_NAMES = (
    "Alabama,Alaska,Arizona,Arkansas,California,Colorado,Connecticut,Delaware,Florida,Georgia,Hawaii,Idaho,Illinois,Indiana,Iowa,Kansas,Kentucky,Louisiana,Maine,Maryland,"
    "Massachusetts,Michigan,Minnesota,Mississippi,Missouri,Montana,Nebraska,Nevada,New Hampshire,New Jersey,New Mexico,New York,North Carolina,North Dakota,Ohio,Oklahoma,Oregon,"
    "Pennsylvania,Rhode Island,South Carolina,South Dakota,Tennessee,Texas,Utah,Vermont,Virginia,Washington,West Virginia,Wisconsin,Wyoming,District of Columbia,Puerto Rico"
)
_ZIP = (
    r"(?:(?<![A-Za-z])[A-Z][A-Za-z.'-]*,\s?(?:" + _STATES.replace(" ", "|") + r")\.?\s{1,2}|\b(?:" + _STATE_NAMES.replace(" ", r"\s").replace(",", "|") + r")\s{1,2}|"
    + _EDGE + r"(?:ZIP|Zip|zip)(?:\s?(?:[Cc]ode|\+4))?\s{0,3}[:#]?\s{0,3}|" + _EDGE + r"[Pp]ostal\s[Cc]ode\s{0,3}[:#]?\s{0,3})(\d{5}(?:-\d{4})?)(?![\d-])"
)
_SUFFIXES = "Street St Avenue Ave Av Road Rd Boulevard Blvd Drive Dr Lane Ln Court Ct Way Place Pl Parkway Pkwy Circle Cir Terrace Ter Highway Hwy Trail Trl Square Sq Loop Pike Plaza Plz Alley Aly Crescent Cres Ridge Rdg".split()
_SUFFIX = "(?:" + "|".join(sorted({w for s in _SUFFIXES for w in (s, s.upper())}, key=lambda w: (-len(w), w))) + r")\b\.?"
_NAME_WORD = r"(?:[A-Z][a-z]+|[A-Z]{2,}|\d{1,3}(?:st|nd|rd|th))"
_STREET = (
    r"(?<![\w./-])\d{1,6}[A-Za-z]?(?:\s1/2)?\s(?:(?:North|South|East|West|NE|NW|SE|SW|N|S|E|W)\.?\s)?" + _NAME_WORD + r"(?:\s" + _NAME_WORD + r"){0,3}\s" + _SUFFIX
    + r"(?:\s(?:NE|NW|SE|SW|N|S|E|W)\b\.?)?(?:,?\s(?:Apt|Apartment|Unit|Suite|Ste|Fl|Floor|Rm|Room|Bldg|APT|UNIT|SUITE|STE)\.?\s?#?\s?[A-Za-z0-9-]{1,6}|,?\s#\s?[A-Za-z0-9-]{1,6})?"
    r"|(?<![A-Za-z])P\.?\s?O\.?\s?[Bb]ox\s\d{1,6}"
)
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_DAY, _MON, _YEAR4, _YEAR, _ORD = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19|20)\d{2}", r"(?:(?:19|20)\d{2}|\d{2})", r"(?:st|nd|rd|th)?"
_NB, _NA = r"(?<![\w/.-])", r"(?![\w/-])"
_DATE = "|".join(
    [
        _NB + _MON + "/" + _DAY + "/" + _YEAR + _NA,
        _NB + _MON + "-" + _DAY + "-" + _YEAR + _NA,
        _NB + _YEAR4 + r"[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])" + _NA,
        _NB + _MON + "/" + _YEAR4 + _NA,
        r"\b" + _MONTH + r"\.?\s" + _DAY + _ORD + r"(?:,?\s" + _YEAR4 + r")?\b",
        r"\b" + _DAY + _ORD + r"\s(?:of\s)?" + _MONTH + r"\.?(?:,?\s" + _YEAR4 + r")?\b",
        r"\b" + _MONTH + r"\.?,?\s" + _YEAR4 + r"\b",
        _NB + _MON + "/" + _DAY + r"(?![\w/%-])(?!\.\d)",
    ]
)
_AGE_NUM = r"(?:9\d|1[01]\d)"
_AGE = "|".join(
    [
        r"\b" + _AGE_NUM + r"(?:\s?-\s?|\s)?(?:years?[\s-]old|yrs?(?:\s?old)?|y/o|y\.o\.|yo)(?![A-Za-z])",
        r"\b[Aa]ge[d]?\s?:?\s?" + _AGE_NUM + r"\b",
        r"\b" + _AGE_NUM + r"(?:yo|y/o)?[MF]\b",
        r"\b" + _AGE_NUM + r"\s(?:yo|y/o)\s?[MF]\b",
        r"\bin\s(?:his|her|their)\s(?:early\s|mid\s|mid-|late\s)?(?:90|100)s\b",
        r"\b[Nn]onagenarian\b|\b[Cc]entenarian\b",
    ]
)
_NAME = r"(?:(?:[A-Z]'|Ma?c)?[A-Z][a-z]+(?:-[A-Z]?[a-z]+)?|[A-Z]{2,}(?:['-][A-Z]{2,})?)"
_INITIAL = r"(?:\s[A-Z]\.)?"
_ROLE_NAME = (
    r"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof)\.?\s{0,2}(" + _NAME + "(?:" + _INITIAL + r"\s" + _NAME + r"){0,2})|"
    r"(?:[Pp]atient(?:\s[Nn]ame)?|[Pp]t\.?(?:\s[Nn]ame)?|[Nn]ame(?=\s{0,2}:)|[Mm]other|[Ff]ather|[Mm]om|[Dd]ad|[Ss]pouse|[Ww]ife|[Hh]usband|[Ss]on|[Dd]aughter|[Ss]ister|[Bb]rother|"
    r"[Gg]uardian|[Cc]aregiver|[Pp]artner|[Ss]igned\sby|[Ee]mergency\s[Cc]ontact)\s{0,2}:?\s{0,2}(" + _NAME + _INITIAL + r"\s" + _NAME + r"(?:\s" + _NAME + r")?))(?![A-Za-z])"
)
_BIRTH = r"(?:DOB|D\.O\.B\.|MRN|[Dd]ate\sof\s[Bb]irth)(?![A-Za-z])"
_HEADER_NAME = (
    r"(?:^|(?<=\n))[ \t]{0,4}(" + _NAME + r",?\s" + _NAME + r")(?=[ \t]{1,4}(?:[A-Z]{0,3}\d{5,}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|" + _BIRTH + r"))|"
    r"(?<![A-Za-z])(" + _NAME + _INITIAL + r"\s" + _NAME + r"(?:\s" + _NAME + r")?)(?=\s{1,2}\(?" + _BIRTH + r")"
)
_H = "[A-Fa-f0-9]{1,4}"
_IPV6 = "|".join([f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", f"(?:{_H}:){{1,6}}:{_H}", *[f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(2, 6)], f"{_H}:(?::{_H}){{1,6}}", f":(?::{_H}){{1,7}}"])
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"

# ---- fixed values: category, switch, on by default, pattern --------------------------------

BUILTIN: tuple[tuple[str, str, bool, str], ...] = (
    ("EMAIL", "detect_emails", True, r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("HICN", "detect_us_health_ids", False, r"(?<![\w-])(?!000|666|9\d\d)\d{3}-?(?!00)\d{2}-?(?!0000)\d{4}-?[A-Z][A-Z0-9]?(?![\w-])"),
    ("SSN_PARTIAL", "detect_us_health_ids", False, _SSN_PARTIAL),
    ("MEDICARE_MBI", "detect_us_health_ids", False, _MBI),
    ("DEA", "detect_us_health_ids", False, r"(?<![A-Za-z0-9])[ABCDEFGHJKLMPRSTUX][A-Z9]\d{7}(?![A-Za-z0-9])"),
    ("NPI", "detect_us_health_ids", False, _EDGE + r"(?:NPI)" + _SEP + r"([12]\d{9})(?!\d)"),
    ("MRN", "detect_us_health_ids", False, _EDGE + _MRN + _SEP + _ID_VALUE),
    ("ACCOUNT_NUMBER", "detect_us_health_ids", False, _EDGE + _ACCOUNT + _SEP + _ID_VALUE),
    ("HEALTH_PLAN_ID", "detect_us_health_ids", False, _EDGE + _PLAN + _SEP + _ID_VALUE),
    ("LICENSE_NUMBER", "detect_us_health_ids", False, _EDGE + _LICENSE + _SEP + _ID_VALUE),
    ("STREET_ADDRESS", "detect_street_addresses", False, _STREET),
    ("ZIP", "detect_zip_codes", False, _ZIP),
    ("DATE", "detect_dates", False, _DATE),
    ("AGE_90PLUS", "detect_ages_over_89", False, _AGE),
    ("ROLE_NAME", "detect_role_names", False, _ROLE_NAME),
    ("HEADER_NAME", "detect_role_names", False, _HEADER_NAME),
    ("SSN", "detect_ssns", True, r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b"),
    (
        "CREDIT_CARD", "detect_credit_cards", True,
        r"(?<!\d)(?:(?:4\d{3}|5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720|352[89]|35[3-8]\d|6011|62\d{2}|64[4-9]\d|65\d{2})([ -]?)\d{4}\1\d{4}\1\d{4}"
        r"|3[47]\d{2}([ -]?)\d{6}\2\d{5}|3(?:0[0-5]\d|6\d{2}|8\d{2})([ -]?)\d{6}\3\d{4}|62\d{15,17})(?!\d)",
    ),
    ("IBAN", "detect_iban", True, r"\b[A-Z]{2}\d{2}(?:\s?[\dA-Z]{4}){2,7}(?:\s?[\dA-Z]{1,4})?\b"),
    (
        "PHONE", "detect_phones", True,
        r"(?<!\d)(?:(?:\+\d{1,3}[-.\s])?(?:\(\d{2,4}\)[-.\s]?|\d{2,4}[-.\s])?\d{3,4}[-.\s]?\d{3,4}|\d{2}(?:[-.\s]\d{2}){3,4})(?!\d)"
        r"|(?<![\d+])\+[1-9]\d{7,14}(?!\d)|(?<!\d)1?[2-9](?:0[1-9]|[1-9]\d)[2-9](?:0[1-9]|[1-9]\d)\d{4}(?!\d)",
    ),
    ("IP_ADDRESS", "detect_ip_addresses", True, r"\b(?:" + _OCTET + r"\.){3}" + _OCTET + r"\b|(?<![\w:])(?:" + _IPV6 + r")(?![\w:])"),
    ("API_KEY", "detect_api_keys", True, r"\b(?:sk|pk|api|key|token|secret|bearer)[-_]?[a-zA-Z0-9_-]{20,512}\b"),
    ("AWS_KEY", "detect_api_keys", True, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("JWT", "detect_api_keys", True, r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b"),
)

_S = r"[\s\-]?"
#: Patterns of each locale, tried before the built-in ones; ``!`` marks those without case.
LOCALES: dict[str, tuple[tuple[str, str], ...]] = {
    "de": (("PHONE_DE", r"(?:\+49\s?|0)[1][5-7]\d[\s\-]?\d{3,4}[\s\-]?\d{4}"), ("PHONE_DE_LAND", r"(?:\+49\s?|0)[2-9]\d{1,4}[\s\-\/]?\d{3,8}"), ("VAT_DE", r"\bDE\d{9}\b")),
    "fr": (("PHONE_FR", r"(?:\+33\s?|0)[1-9](?:[\s\.\-]?\d{2}){4}"), ("NIR_FR", r"\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2])\s?(?:\d{2}|2[AB])\s?\d{3}\s?\d{3}\s?\d{2}\b")),
    "es": (("PHONE_ES", r"(?:\+34\s?)?[6-9]\d{2}[\s\-]?\d{2,3}[\s\-]?\d{2,3}[\s\-]?\d{2,3}"), ("DNI_ES", r"\b\d{8}[A-HJ-NP-TV-Z]\b"), ("NIE_ES", r"\b[XYZ]\d{7}[A-HJ-NP-TV-Z]\b")),
    "nl": (("PHONE_NL", r"(?:\+31\s?[1-9]\d|06)[\s\-]?\d{4}[\s\-]?\d{4}"), ("POSTAL_NL", r"\b\d{4}\s?[A-Z]{2}\b"), ("!BSN_NL", r"(?:bsn|burgerservicenummer|sofi)[\s:]*(\d{9})\b")),
    "he": (("PHONE_IL", r"(?:\+972[\s\-]?|0)5[0-9][\s\-]?\d{3}[\s\-]?\d{4}"), ("PHONE_IL_LAND", r"(?:\+972[\s\-]?|0)[2-489][\s\-]?\d{7}")),
    "zh": (("NATIONAL_ID_CN", r"\b\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"), ("PHONE_CN", r"(?:\+86\s?)?1[3-9]\d[\s\-]?\d{4}[\s\-]?\d{4}")),
    "ja": (("PHONE_JP", r"(?:\+81\s?|0)[789]0[\s\-]?\d{4}[\s\-]?\d{4}"), ("PHONE_JP_LAND", r"(?:\+81\s?|0)[1-9]\d{0,3}[\s\-]?\d{2,4}[\s\-]?\d{4}"), ("!MY_NUMBER_JP", r"(?:マイナンバー|my\s?number)[\s:]*(\d{12})\b")),
    "ru": (
        ("PHONE_RU", r"(?:\+7|8)[\s\-]?\(?9\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"), ("PHONE_RU_LAND", r"(?:\+7|8)[\s\-]?\(?[3-8]\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"),
        ("SNILS_RU", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b"), ("!INN_RU", r"(?:[иИ][нН][нН]|inn)[\s:]*(\d{10}(?:\d{2})?)\b"),
    ),
    "ko": (
        ("PHONE_KR", r"(?:\+82[\s\-]?)?0?1[016789][\s\-]?\d{3,4}[\s\-]?\d{4}"), ("PHONE_KR_LAND", r"(?:\+82[\s\-]?)?0[2-6]\d?[\s\-]?\d{3,4}[\s\-]?\d{4}"),
        ("RRN_KR", r"\b\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]\d{7}\b"),
    ),
    "it": (
        ("PHONE_IT", r"(?:\+39[\s\-]?)?3\d{2}[\s\-]?\d{6,7}"), ("PHONE_IT_LAND", r"(?:\+39[\s\-]?)?0\d{1,3}[\s\-]?\d{4,8}"),
        ("CODICE_FISCALE_IT", r"\b[A-Z]{6}\d{2}[ABCDEHLMPRST](?:[0-4]\d|[5-7][01])[A-Z]\d{3}[A-Z]\b"),
    ),
    "pl": (
        ("PHONE_PL", r"(?:\+48[\s\-]?)?\d{3}[\s\-]?\d{3}[\s\-]?\d{3}"), ("!PESEL_PL", r"(?:pesel)[\s:]*(\d{2}(?:[02468][1-9]|[13579][012])(?:0[1-9]|[12]\d|3[01])\d{5})\b"),
        ("!NIP_PL", r"(?:nip)[\s:]*(\d{3}-?\d{3}-?\d{2}-?\d{2})\b"),
    ),
    "pt": (("PHONE_PT", r"(?:\+351[\s\-]?)?9[1236]\d[\s\-]?\d{3}[\s\-]?\d{3}"), ("PHONE_BR", r"(?:\+55[\s\-]?)?\(?[1-9]\d\)?[\s\-]?9?\d{4}[\s\-]?\d{4}"), ("CPF_BR", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b")),
    "hi": (
        ("PHONE_IN", r"(?:\+91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}"), ("PAN_IN", r"\b[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]\b"),
        ("!AADHAAR_IN", r"(?:aadhaar|आधार|uidai)[\s:]*([2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4})\b"),
    ),
}

#: Categories of which only the captured value is a detection, not its label.
VALUE_ONLY = frozenset({"MRN", "ACCOUNT_NUMBER", "HEALTH_PLAN_ID", "LICENSE_NUMBER", "NPI", "SSN_PARTIAL", "ZIP"})
HEALTH_IDS = frozenset({"MRN", "ACCOUNT_NUMBER", "HEALTH_PLAN_ID", "LICENSE_NUMBER", "NPI", "MEDICARE_MBI", "HICN", "DEA", "SSN_PARTIAL"})
ROLE_NAMES = frozenset({"ROLE_NAME", "HEADER_NAME"})

# Words around a match, and words that are no names.
PHONE_CONTEXT = re.compile(r"(?:call(?:ed|ing)?|phone|telephone|tel|mobile|cell|fax|contact|reach|dial|ring|whatsapp|sms|text)(?:\W+(?:\w{1,4}|numbers?)){0,2}\W{0,4}\Z", re.I | re.A)
MEDICARE_CONTEXT = re.compile(r"(?:[Mm]edicare|MBI|HICN|[Bb]eneficiary)\W{0,12}(?:\w+\W{1,3}){0,2}\Z", re.A)
DATE_CONTEXT = re.compile(
    r"(?:\bon|\bsince|\bfrom|\buntil|\btill|\bby|\bdated?|\bseen|\badmitted|\badm|\bdischarged|\bd/c|\bDOS|\bDOB|\bLMP|\bEDD|\bscheduled|\bappt|\bf/u|\bfollow[- ]?up|\bvisit|\bsurgery|"
    r"\bprocedure|\blast|\bnext|\bstart(?:ed|ing)?|\bbegan|\bdue)\W{0,3}\Z",
    re.I | re.A,
)
RATIO_AFTER = re.compile(r"\s?(?:strength|pain|tab|tabs|tablet|of\b|dose|scale|ratio|split|units?\b|ml\b|mg\b|cm\b|mm\b|hpf\b|lpf\b|vision|murmur|systolic|diastolic)", re.I | re.A)
TEMPERATURE_BEFORE = re.compile(r"(?:\btemp|\bt|°)\W{0,3}\Z", re.I | re.A)
STOP_WORDS = frozenset(
    "ID Id Portal Education Instructions Information Info Name Number No Care Safety History Record Records Consent Summary Report Reports Reported States Stated Denies Denied Presents Presented "
    "Tolerated Complains Arrived Admits Admitted Visits Visit Notes Note Plan Status Satisfaction Experience Advocate Services Account Address Phone Email Signature Date Medications Allergies "
    "Location Room Bed Unit Type Class Follow Up Lab Labs Results Vitals Order Orders Discharge Admission Is Was Has Had The And Or Not To In On At With Of For".split()
)
NO_SURNAMES = STOP_WORDS | frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "MD DO RN NP PA PhD DDS Hospital Clinic Center Medical Health Street Avenue Road".split()
)
SURNAME_AFTER = re.compile(r" ((?:[A-Z]'|Ma?c)?[A-Z][a-z]+(?:-[A-Z]?[a-z]+)?)(?![A-Za-z'])", re.A)
