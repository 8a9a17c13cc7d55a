"""Fixed values.

Everything in this module is data that must hold exactly these values for results
to be right: vocabularies, labels, patterns and text formats.  No logic lives here.
Patterns are written for ASCII word boundaries and Unicode white space;
``mailfold.functions.text.jvm`` renders them for the JVM's regex dialect.
"""

# --- fixed values: enumerations and labels ------------------------------------

STATUSES = ("applied", "interview", "offer", "rejected")
CATEGORIES = ("applied", "interview", "offer", "rejected", "ignored")
STEPS = ("phone_screen", "technical", "onsite", "final")
USER_SOURCES = ("manual", "csv")

STATUS_LABELS = {
    "applied": "Applied",
    "interview": "Interview",
    "offer": "Offer",
    "rejected": "Rejected",
}
STEP_LABELS = {
    "phone_screen": "Phone Screen",
    "technical": "Technical",
    "onsite": "Onsite",
    "final": "Final Round",
}
STAGE = {"applied": 0, "interview": 1, "offer": 2, "rejected": 2}
TERMINAL = ("offer", "rejected")

UNKNOWN_ROLE = "Unknown Role"
PAIR_WINDOW_DAYS = 4
SCAN_WINDOWS = (30, 60, 90, 180)
PAGE_SIZE = 25
BOARD_PREVIEW = 3

NOTE_PREFIX = "Auto-detected from Gmail: "
NOTE_WARNING = "\n⚠️ Role could not be extracted — please update manually."
BADGE_IMPORTED = "📄 Imported"
BADGES = {"parser": "⚙️ Detected by Parser", "llm": "🤖 Detected by AI"}
LINK_FAST = "⚡ Fast Applied"
LINK_STAGE = "✉ "
MESSAGE_URL = "https://mail.google.com/mail/u/0/"

# --- fixed values: company identity -------------------------------------------

# Hosts that send for many employers, and public mail providers.
SHARED_HOSTS = (
    "greenhouse.io", "greenhouse-mail.io", "lever.co", "icims.com", "taleo.net", "bamboohr.com",
    "smartrecruiters.com", "jobvite.com", "jazz.co", "breezy.hr",
    "workday.com", "myworkday.com", "successfactors.com", "applytojob.com",
    "recruitingbypaycor.com", "paylocity.com", "adp.com", "ultipro.com",
    "indeed.com", "linkedin.com", "glassdoor.com", "ziprecruiter.com",
    "rippling.com", "brassring.com", "ashbyhq.com", "applyresponse.com", "workablemail.com", "kula.ai",
    "candidatecare.com",
    "governmentjobs.com", "clearcompany.com", "gem.com", "oracle.com", "ns2cloud.com", "applicantemails.com",
    "hackerrank.com", "hackerrankforwork.com", "codility.com", "codesignal.com", "hackerearth.com",
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
)

# Extra words that do not make a different employer.
DESCRIPTORS = (
    "group", "holdings", "capital", "partners", "ventures", "international", "global", "worldwide",
    "industries", "enterprises", "company", "brands", "labs", "studios", "inc", "llc", "ltd", "plc",
    "corp", "corporation", "co", "management", "advisors", "advisory", "asset", "investments",
    "technologies", "technology", "tech", "sciences", "science", "systems", "solutions", "software",
    "hardware", "digital", "services", "consulting", "networks", "communications", "analytics",
    "security", "cloud", "data", "robotics", "semiconductor", "semiconductors", "electronics",
    "financial", "finance", "trust", "health", "healthcare", "bank", "media", "pharmaceuticals", "pharma",
    "bio", "biosciences", "therapeutics", "diagnostics", "energy", "power", "retail", "foods", "food",
    "motors", "automotive", "aerospace", "travel", "hospitality", "insurance", "mortgage", "realty",
    "logistics", "transport", "transportation", "education", "learning", "payments", "lending",
    "entertainment", "games", "gaming", "sports", "fitness", "apparel", "beverages", "restaurants",
    "hotels", "airlines", "telecom", "telecommunications", "mobility", "space", "defense", "materials",
)

SECOND_LEVEL_TLD = r"^(?:co|com|org|net|gov|edu|ac|or|ne|go)\.[a-z]{2}$"
TRADE_NAME_PREFIX = r"(?i)^.*?\bd\/?b\/?a\b\s*"
PAGE_QUALIFIER = (
    r"(?i)\s+[-–]\s+(?:Corporate|Corp|HQ|Headquarters|Global|US|USA|U\.S\.A?\.?|North America|EMEA|APAC|Worldwide)\.?$"
)
LEGAL_SUFFIX = (
    r"(?i)(?<=\w)[,.]?\s+(?:company|incorporated|inc\.?|llc|ltd\.?|corp\.?|corporation|co\.)$"
)
ASSESSMENT_NAME = r"(?i)^hacker\s?rank\b"
ASSESSMENT_HOST = r"(?i)hackerrankforwork\.(?:com|io)"

# --- fixed values: senders and template codes ---------------------------------

BOARD_A_SENDER = "jobs-noreply@linkedin.com"
BOARD_B_SENDER = "indeedapply@indeed.com"
CODE_A_APPLIED = "linkedin_applied"
CODE_A_REJECTED = "linkedin_rejected"
CODE_B_APPLIED = "indeed_applied"
CODE_GENERAL = "general_template"
FAST_CODES = (CODE_A_APPLIED, CODE_B_APPLIED)

BOARD_A_SUBJECT = r"(?i)your application was sent to"
BOARD_A_HEADING = r"(?i)^your application was sent to\b"
BOARD_A_MARKER = r"(?i)^(?:view job|applied on)\b"
BOARD_A_REJECT_SUBJECT = r"(?i)^your application to "
BOARD_A_REJECT_BODY = r"(?i)your update from "
BOARD_B_SUBJECT = r"(?i)^Indeed Application:\s*(.+)$"
BOARD_B_EMPLOYER = r"(?im)^Employer:\s*(.+)"
BOARD_B_SENT_TO = r"(?i)sent to ([^.]+)\."

# --- fixed values: retrieval phrases ------------------------------------------

WANTED_PHRASES = (
    "your application",
    "recent application",
    "thank you for applying",
    "thanks for applying",
    "application received",
    "application submitted",
    "application update",
    "application status",
    "job application",
    "indeed application",
    "career opportunities",
    "your candidacy",
    "hiring process",
    "hiring team",
    "your interview",
    "interview request",
    "interview invitation",
    "moving forward with other",
    "not be moving forward",
    "regret to",
    "wasn't the right fit",
    "isn't the best fit",
    "not the right fit",
    "not the best fit",
    "start date",
    "welcome aboard",
    "job offer",
    "offer letter",
    "thank you for your interest",
    "interview for",
    "schedule your interview",
)
EXCLUDED_MAILBOX_CATEGORIES = ("promotions", "social")
EXCLUDED_SENDERS = ("updates-noreply@linkedin.com", "noreply@newsletters.nyc.gov")
EXCLUDED_ANYWHERE = (
    "jobs you're a good match for",
    "Glassdoor Community",
    "Account Verification",
    "Action Required",
    "Apply Soon",
    "EAP Discount Rate",
)
EXCLUDED_SUBJECTS = (
    "you may be a fit for",
    "new jobs similar to",
    "quick question about your application at",
    "we'd love to hear about your application experience",
    "Apply Now",
    "is still available",
    "you've started your job application",
    "continue to apply",
    "incomplete",
    "complete your",
    "your application was viewed",
    "draft",
    "Quick Update!",
    "Demographic Survey",
    "reminder",
    "career opportunities at",
    "interview confirmation",
    "interview confirmed",
    "has been scheduled",
    "calendar invite",
    "meeting confirmed",
    "you have started an application!",
    "additional information needed",
)

# --- fixed values: noise patterns ---------------------------------------------

NOISE_SUBJECTS = (
    r"^automatic reply",
    r"^auto:",
    r"^out of office",
    r"interview confirmation",
    r"interview confirmed",
    r"your interview (is|has been) (confirmed|scheduled)",
    r"has been scheduled",
    r"calendar invite",
    r"meeting confirmed",
    r"reminder",
    r"jobs? alert",
    r"new jobs? for you",
    r"\d+ new jobs?",
    r"your career opportunities at",
    r"email address validation",
    r"verify your email",
    r"confirm your email",
    r"verification code",
    r"one[\s-]?time",
    r"activate your account",
    r"sign[\s-]?in link",
    r"log[\s-]?in link",
    r"magic link",
    r"quick question about your application at",
    r"jacobs - application update(?!,)",
)
NOISE_SENDER = r"(?i)calendly\."
NOISE_BODY = (
    r"(?i)\bplanning to make a change\b|\bknow of a friend\b|\breferral bonus\b"
    r"|\bour records (?:show|indicate)\b|\bmy current opening|\beven if we have spoken recently\b"
    r"|\b(?:c2c|corp[\s-]?to[\s-]?corp|w-?2|1099|contract to hire)\b"
)

# --- fixed values: body cleaning ----------------------------------------------

STYLE_BLOCK = r"(?i)<style[\s\S]*?<\/style>"
SCRIPT_BLOCK = r"(?i)<script[\s\S]*?<\/script>"
ANY_TAG = r"<[^>]+>"
MARKUP_SEEN = r"(?i)<[a-z][\s\S]*?>"
TEMPLATE_MARKERS = r"<%|\{\{|\{%|\bI18n\.t\b"
ENTITIES = (
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&#39;", "'"),
    (r"(?i)&rsquo;", "'"),
    (r"(?i)&lsquo;", "'"),
    (r"(?i)&rdquo;", '"'),
    (r"(?i)&ldquo;", '"'),
    (r"(?i)&hellip;", "..."),
    (r"(?i)&zwnj;", ""),
    (r"(?i)&#x0*27;", "'"),
    (r"(?i)&#x201[89];", "'"),
    (r"(?i)&#x201[cd];", '"'),
    (r"(?i)&#x[0-9a-f]+;", " "),
    (r"&#\d+;", " "),
)
INVISIBLE = "[\u00A0\u00AD\u200B-\u200F\u2028\u2029\uFEFF]"
ARTIFACT_TEMPLATE = r"(?i)^\s*RTF Template\s*"
ARTIFACT_NUMBER = r"(?i)^\s*96\s+"
LINK_MARKER = r"\[\d+\]"
URL = r"https?:\/\/\S+"
DIVIDER = r"(?:[*\-=_~+•]\s?){4,}"
REPLY_NOTICES = (
    r"(?i)\b(?:please\s+)?do not (?:reply|respond) to this (?:email|message)\b[^.!?\n]*[.!?]?",
    r"(?i)\bif you reply to this (?:email|message)\b[^.!?\n]*[.!?]?",
    r"(?i)\breplies (?:to this (?:message|email) )?(?:are undeliverable|will not (?:be (?:read|delivered)|reach))\b[^.!?\n]*[.!?]?",
)
FOOTER = (
    r"(?i)please do not reply to this (?:email|message)|this is an auto(?:matically)? generated email"
    r"|this message was sent to \S+@\S+|if you (?:don.t|no longer) want to receive"
    r"|references\s+visible links|copyright \(c\) \d{4}|\ball rights reserved\b"
    r"|this email was intended for \S+@\S+|sorry, replies to this message can.t be delivered"
    r"|connect with .{1,40} on linkedin|facebook \| twitter|instagram \| linkedin|\*{10,}"
)
CARD_TAIL = r"(?i)Now, take these next steps|View similar jobs you may"
CARD_LINK_LINE = r"(?i)^view job:?$"

# --- fixed values: requisition numbers ----------------------------------------

REQ_TOKEN = r"[A-Za-z]{0,3}[0-9][0-9A-Za-z]*(?:-[0-9][0-9A-Za-z]*)*"
REQ_LABELLED = (
    r"(?i)\b(?:job\s*(?:number|id|no\.?|#)|req(?:uisition)?(?:\s*(?:id|number|no\.?|#))?|requisition)[\s:#]+("
    + REQ_TOKEN + ")"
)
REQ_ID_LABEL = r"(?i)\bID\s*[:#]\s*(" + REQ_TOKEN + ")"
REQ_MIXED = r"\b([A-Za-z]{1,3}[0-9]{5,}|[0-9]{5,}[A-Za-z]{1,3})\b"
REQ_DASHED = r"[-–]\s*([0-9]{4,}(?:-[0-9]{2,})?|[0-9]{6,})\b"
REQ_LABEL_PREFIX = (
    r"(?i)^(?:(?:job|req(?:uisition)?|ref(?:erence)?|number|no|id)[\s.:#-]+)+(?=[0-9A-Za-z])"
)
REQ_VALID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
REQ_MIN_DIGITS = 5

# --- fixed values: job titles --------------------------------------------------

ROLE_LEADING_REQ = r"^#?[A-Za-z]{0,4}[-_]?[0-9][0-9A-Za-z-]*\s+(?=\S)"
ROLE_ID_STRIPS = (
    (r"\s*\{[^}]*\}\s*", " "),
    (r"\s*\[\s*#?[A-Za-z]{0,5}[-_: ]?\d[\dA-Za-z._\-/ ]*\]\s*", " "),
    (r"(?i)\s*\(\s*(?:ref(?:erence)?|requisition|req|job|id|no)\b[^)]*\)\s*$", ""),
    (r"\s*\(\s*#?[A-Za-z]{0,5}[-_: ]?\d[\dA-Za-z._\-/ ]*\)\s*$", ""),
    (r"\s*[-–]\s*#?(?:\d{1,4}[-_]\d{2,}|[A-Za-z]{1,6}[-_]?\d{2,}|\d{5,})[A-Za-z]{0,3}$", ""),
    (r"\s+#?(?:[A-Za-z]{1,3}\d{4,}|\d{4,}[A-Za-z]{1,3}|\d{5,})$", ""),
)
ROLE_TAIL_STRIPS = (
    (r"(?i)\s+(?:onsite|hybrid|remote)\b.*$", ""),
    (r"\s*[-–,]\s*[A-Z][A-Za-z. ]+?,\s*[A-Z]{2}\b.*$", ""),
    (r"(?i)\s+(?:United\s+(?:States|Kingdom)|USA?|UK)\b(?:\s*\([A-Za-z]{2,3}\))?$", ""),
    (r"[\s,\-–]+$", ""),
)
ROLE_ARTICLE = r"(?i)^(?:the|an?|our|your)\s+"
ROLE_POSSESSIVE = r"^[A-Z][\w&.]*'s\s+"
ROLE_START = r"^(?:\([^)]*\)\s*)?[A-Z0-9]"
ROLE_OVERRUN = r"(?i)\bposition\b"
ROLE_PROSE = (
    r"\b(?:will|would|shall|be|been|being|are|is|was|were|do|does|did|have|has|had|we|us|our|you|your"
    r"|they|them|their|this|that|these|those|evaluating|reviewing|received|receive|submitted"
    r"|considering|currently|please|thanks)\b"
)
ROLE_COUNTRY = r"(?i)^United\s+(?:States|Kingdom)\b"
ROLE_LENGTH = (2, 80)

# (field, pattern) in priority order; the capture is the title.
ROLE_RECOVERY = (
    ("subject", r"(?i)\bJob Application:.*?[-–]\s*\d+\s+([A-Z][^\n]*?)\s+on\s+\d"),
    ("body", r"\b(?:position|role) of\s+(?:\d{5,}\s+)?([A-Z][^.!?\n]*?)(?=[.!?,]|\s+(?:has|have|is|was|at|with|on)\b|$)"),
    ("body", r"\b(?:for|to|exploring)\s+(?:the\s+|our\s+|your\s+|a\s+)?((?:\([^)]*\)\s*)?[A-Z][^.!?\n]*?)\s+(?:role|position|opportunity|opening)\b"),
    ("body", r"\b(?:in|for)\s+the\s+((?:\([^)]*\)\s*)?[A-Z][^.!?\n]*?)\s+(?:role|position|opening|opportunity)\b"),
    ("body", r"\bour\s+(?:open\s+)?([A-Z][^.!?\n]*?)\s+(?:role|position|opening)\b"),
    ("body", r"\bapplication for the\s+([A-Z][^.!?\n]*?)\s+(?:job|position|role)\b"),
    ("body", r"(?i)\bfollowing\s+(?:job|position)(?:\(s\)|s)?\s*:?\s+([A-Z][^.!?\n]+?)(?=[.!?\n]|$)"),
    ("body", r"(?i)\bjoining\s+(?:us|the\s+team)\s+as\s+(?:an?\s+)?([A-Z][^.!?\n]*?)(?=[.!?\n]|$)"),
    ("body", r"(?i)\bapplication for:\s+(?:#?[A-Za-z]{0,3}\d[\w./-]*\s+)?([A-Z][^!?\n]*?)(?=[.!?\n]|$)"),
    ("body", r"\b(?:application|applied|apply(?:ing)?)\s+for\s+(?:the\s+|our\s+|an?\s+)?([A-Z][^.!?\n,]*?)(?=,|\s+(?:and|position|role|opening|opportunity|job|at|with|here)\b|[.!?\n]|$)"),
    ("subject", r"(?i)\bapplication for\s+(?:the\s+)?(.+)$"),
    ("body", r"\bthe\s+([A-Z](?:[^.!?\n()]|\([^)]*\))*?)\s+(?:role|position|opening|opportunity)\b"),
)

# --- fixed values: employer sentences ------------------------------------------

COMPANY_RUN = r"^[A-Z][\w.&'()/-]*(?:\s+(?:(?:and|of|the|&)\s+)?[A-Z0-9][\w.&'()/-]*)*"
COMPANY_LENGTH = (2, 50)
COMPANY_REQ_SHAPE = r"^(?:req)?\d|^[A-Z]{0,4}\d{3,}"
COMPANY_REQ_WORD = r"(?i)^req(?:uisition)?\b"
NOT_APPLICATION = r"(?i)\b(demographic|survey)\b"
DRAFT_REMINDER = (
    r"(?i)keep track of your application|still working on the application|if you have completed the application"
)
NAME_CAPTURE = r"([^.,!?\n]+?)"
NAME_END = r"(?=[.,!?\n]|$)"
# (field, pattern, company group, role group) in priority order.
EMPLOYER_AND_TITLE = (
    ("text", r"(?i)\b(?:applying|application|apply) for (?:the\s+|an?\s+)?(?:(?:role|position) of\s+)?([^.!?\n]+?)(?:\s+(?:position|role))?\s+(?:at|with)\s+" + NAME_CAPTURE + NAME_END, 2, 1),
    ("text", r"(?i)\b(?:applying|application|applied|apply) to (?:the\s+|an?\s+)?([^.!?\n]+?)\s+(?:opening|position|role|opportunity)\s+(?:at|with)\s+" + NAME_CAPTURE + NAME_END, 2, 1),
    ("text", r"(?i)your interest in (?:the\s+|an?\s+)?([^.!?\n]+?)\s+(?:position|opportunity|opening|role)\s+(?:at|with)\s+" + NAME_CAPTURE + NAME_END, 2, 1),
    ("text", r"(?i)employment with\s+" + NAME_CAPTURE + r"\s+in our\s+([^.!?\n]+?)\s+position", 1, 2),
    ("subject", r"(?i)\b(?:applying to|application to|apply to|your application to)\s+(.+?)\s+[-–]\s+(.+)$", 1, 2),
)
EMPLOYER_ONLY = (
    r"(?i)joining (?:the\s+)?" + NAME_CAPTURE + NAME_END,
    r"(?i)\bcareer(?:\s+opportunities)?\s+at\s+" + NAME_CAPTURE + NAME_END,
    r"(?i)\b(?:applying to|application to|apply at)\s+" + NAME_CAPTURE + NAME_END,
    r"(?i)\b(?:your |the )?interest in " + NAME_CAPTURE + NAME_END,
)
TITLE_NOUNS = r"\s+(?:position|role|opening|opportunity)\b"

# --- fixed values: status phrases ----------------------------------------------

SENTENCE_BREAK = r"(?<=[.!?])\s+"
REJECT_PHRASES = (
    r"(?i)regret to inform|not be proceeding|other candidates|pursue other"
    r"|mov(?:e|ing) forward with (?:other )?(?:candidates|applicants)"
    r"|\b(?:not|won'?t|will not|unable to|cannot|can'?t)\s+(?:be\s+|to\s+)?(?:mov(?:e|ing)\s+forward|progress|proceed)\b"
    r"|\bnot\s+selected\b|decided to (?:go|proceed) with|will not be progressing"
    r"|selected (?:a|the|another) candidate|\bbeen filled\b|\b(?:is|was|now)\s+filled\b|\bno longer hiring\b"
)
CONDITIONAL = r"(?i)\bif\b"
APPLIED_PHRASES = (
    r"(?i)received your application|application (?:has been|was) received|we will review|we'?ll review"
    r"|under review|currently reviewing|reviewing your (?:application|profile)|will be in touch"
    r"|get back to you|look forward to reviewing|if your (?:qualifications|skills|background|experience)"
    r"|if there (?:is|'?s) a (?:match|fit|potential)|confirm receipt|has been (?:submitted|received)"
    r"|status of your application|successfully (?:submitted|received|applied)"
)
CONFIRMATION_PHRASES = (
    r"(?i)received your (?:job )?application|application (?:has been|was) (?:received|sent)"
    r"|thank(?:s| you) for (?:applying|submitting)|we will (?:contact|be in touch|review)"
)
UPDATE_SUBJECT = r"(?i)\bupdate\b"

# --- fixed values: sheets --------------------------------------------------------

CSV_HEADERS = (
    "Company", "Role", "Status", "Stage", "Reached Interview", "Date Applied", "Last Response",
    "Job URL", "Notes", "Source", "Company Domain", "Job ID", "Gmail Account", "Emails",
)
CSV_FIELDS = {
    "company": "company",
    "role": "role",
    "status": "status",
    "stage": "interview_step",
    "reached interview": "reached_interview",
    "date applied": "date_applied",
    "last response": "last_activity",
    "job url": "job_url",
    "notes": "notes",
    "company domain": "company_domain",
    "job id": "external_id",
    "gmail account": "account",
    "emails": "emails",
}
REF_FIELD_SEP = "|"
REF_ENTRY_SEP = " ; "
REF_FAST_FLAG = "fast"

# --- fixed values: words that patterns need ---------------------------------------

# A pattern can match only a text that holds, ignoring case, one of its words.
_TITLE_WORDS = ("role", "position", "opening", "opportunity")
NEEDED_WORDS = {
    "(?i)" + "|".join(NOISE_SUBJECTS): (
        "automatic reply", "auto:", "out of office", "interview confirm", "your interview ", "has been scheduled",
        "calendar invite", "meeting confirmed", "reminder", "alert", "new job", "career opportunities at", "email",
        "verification code", "time", "activate your account", "in link", "magic link", "quick question", "jacobs",
    ),
    NOISE_SENDER: ("calendly.",),
    NOISE_BODY: (
        "planning to make a change", "know of a friend", "referral bonus", "our records ", "my current opening",
        "even if we have spoken", "c2c", "corp", "w2", "w-2", "1099", "contract to hire",
    ),
    TRADE_NAME_PREFIX: ("dba", "d/ba", "db/a", "d/b/a"),
    PAGE_QUALIFIER: ("-", "–"),
    LEGAL_SUFFIX: ("company", "inc", "llc", "ltd", "corp", "co."),
    REPLY_NOTICES[0]: ("do not re",),
    REPLY_NOTICES[1]: ("if you reply to this ",),
    REPLY_NOTICES[2]: ("replies ",),
    FOOTER: (
        "please do not reply to this ", "this is an auto", "this message was sent to ", "want to receive", "references",
        "copyright (c) ", "all rights reserved", "this email was intended for ", "sorry, replies to this message",
        "connect with ", "facebook | twitter", "instagram | linkedin", "**********",
    ),
    REQ_LABELLED: ("job", "req"),
    REQ_ID_LABEL: ("id",),
    REQ_DASHED: ("-", "–"),
    ROLE_TAIL_STRIPS: ("onsite", "hybrid", "remote", "united", "us", "uk", ",", "-", "–"),
    ROLE_RECOVERY[0][1]: ("job application:",),
    ROLE_RECOVERY[1][1]: ("position of", "role of"),
    ROLE_RECOVERY[2][1]: _TITLE_WORDS,
    ROLE_RECOVERY[3][1]: _TITLE_WORDS,
    ROLE_RECOVERY[4][1]: ("role", "position", "opening"),
    ROLE_RECOVERY[5][1]: ("application for the",),
    ROLE_RECOVERY[6][1]: ("following",),
    ROLE_RECOVERY[7][1]: ("joining",),
    ROLE_RECOVERY[8][1]: ("application for:",),
    ROLE_RECOVERY[9][1]: ("application", "applied", "apply"),
    ROLE_RECOVERY[10][1]: ("application for",),
    ROLE_RECOVERY[11][1]: _TITLE_WORDS,
    NOT_APPLICATION: ("demographic", "survey"),
    DRAFT_REMINDER: (
        "keep track of your application", "still working on the application", "if you have completed the application",
    ),
    EMPLOYER_AND_TITLE[0][1]: ("applying for ", "application for ", "apply for "),
    EMPLOYER_AND_TITLE[1][1]: ("applying to ", "application to ", "applied to ", "apply to "),
    EMPLOYER_AND_TITLE[2][1]: ("your interest in ",),
    EMPLOYER_AND_TITLE[3][1]: ("employment with",),
    EMPLOYER_AND_TITLE[4][1]: ("applying to", "application to", "apply to"),
    EMPLOYER_ONLY[0]: ("joining ",),
    EMPLOYER_ONLY[1]: ("career",),
    EMPLOYER_ONLY[2]: ("applying to", "application to", "apply at"),
    EMPLOYER_ONLY[3]: ("interest in ",),
    REJECT_PHRASES: (
        "regret to inform", "proceed", "other candidates", "pursue other", "forward", "progress", "selected",
        "decided to ", "filled", "no longer hiring",
    ),
    CONDITIONAL: ("if",),
    APPLIED_PHRASES: (
        "review", "received your application", "application was received", "will be in touch", "get back to you",
        "if your ", "if there ", "confirm receipt", "has been ", "status of your application", "successfully ",
    ),
    CONFIRMATION_PHRASES: (
        "received your ", "application has been ", "application was ", "thanks for ", "thank you for ", "we will ",
    ),
    UPDATE_SUBJECT: ("update",),
}
