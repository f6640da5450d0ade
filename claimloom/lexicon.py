"""Word lists and patterns. Fixed values; results depend on each of them.

Patterns are written for Java and RE2 alike; (?i) marks those without case.
"""

# Tokens that carry no content when evidence is scored.
EVIDENCE_STOPWORDS = """a an and are as at be by case court decide decided did for in is it of on or question regarding
sentence sentencing supreme that the this to united what when which""".split()
# Tokens that carry no content in pair scores.
PAIR_STOPWORDS = """a an and are as at be but by can did do does for from had has have in is it its of on or that the their
this to under was were what with""".split()
# Tokens that carry no content when contradictions are checked.
CONTRADICTION_STOPWORDS = """a an and are as at be because by case court did do does for from has have in is it its of on or
that the their this to v was were when which with""".split()
# Negations.
NEGATIONS = ["no", "not", "never", "none", "cannot", "cant", "won't", "wont", "without"]
# Words of opposite meaning.
POLARITY = [
    (["grant", "granted", "grants"], ["deny", "denied", "denies"]),
    (["affirm", "affirmed", "affirms"], ["reverse", "reversed", "reverses"]),
    (["constitutional", "valid"], ["unconstitutional", "invalid"]),
    (["authorize", "authorized", "allows", "allow"], ["prohibit", "prohibited", "bars", "bar"]),
]
# Phrases that anchor a claim to a matter.
ANCHOR_PHRASES = [
    "removal petition",
    "statement of jurisdiction",
    "jurisdictional statement",
    "domestic violence restraining order",
    "preliminary injunction",
    "article iii standing",
    "equal protection clause",
    "fourteenth amendment",
    "second amendment",
    "first amendment",
    "takings clause",
]
# Verbs by which a clause is split.
VERBS = """accept affirm allege appeal argue arrest assert award claim conclude concern contend deny determine dismiss enter
file find grant hold leave order receive remand request return reverse rule say seek state submit testify vacate""".split()
# Name parts that do not tell one party from another.
SHORT_NAME_STOPWORDS = """administration agency america american association bank bondi city commissioner company corp
corporation department federal group inc incorporated llc new resources state states transit trust united university usa""".split()
# Company forms, dropped from names.
COMPANY_TOKENS = ["co", "company", "corp", "corporation", "inc", "incorporated", "llc", "ltd"]
# Tokens too general to tie a claim to research leads.
LEADS_GENERIC = """action actions agency article authority challenge claim claims concrete defendant demonstrate federal
government held injury law legal likely plaintiff plaintiffs regulation requires rule show standing statute""".split()
# Tokens too general to be the subject of a question.
SUBJECT_GENERIC = """about answer authority case claim court database does explain holding instead mention mentioned only
retrieved rule say source sources summarize using""".split()

# Terms added to a broad question, and terms added where a trigger stands in it.
AUTHORITY_TERMS = ["case", "authority", "precedent", "holding", "standard"]
EXPANSIONS = [
    (["standing"], ["article iii", "injury in fact", "causation", "redressability"]),
    (["certiorari", "cert"], ["petition", "writ", "denied", "granted", "supreme court review"]),
    (["injunction", "enjoin"], ["preliminary injunction", "irreparable harm", "equitable relief"]),
    (["dismissal", "dismiss"], ["motion to dismiss", "failure to state a claim", "rule 12"]),
    (["summary judgment"], ["genuine dispute", "material fact", "rule 56"]),
    (["remand"], ["vacate", "reverse", "further proceedings", "jurisdiction"]),
    (["damages"], ["remedy", "compensatory damages", "punitive damages", "relief"]),
    (["penalty", "penalties"], ["sanction", "fine", "civil penalty", "consequence"]),
    (["exclusion", "suppress", "suppression"], ["exclusionary rule", "motion to suppress", "fourth amendment"]),
    (["sanction", "sanctions"], ["rule 11", "discipline", "penalty", "bad faith"]),
    (["search", "seizure"], ["fourth amendment", "warrant", "probable cause", "reasonable suspicion"]),
    (["due process"], ["notice", "hearing", "procedural due process", "substantive due process"]),
    (["equal protection"], ["scrutiny", "classification", "fourteenth amendment"]),
    (["first amendment", "speech"], ["free speech", "content based", "public forum", "strict scrutiny"]),
    (["administrative", "agency"], ["arbitrary and capricious", "administrative procedure act", "deference"]),
]

# Patterns of questions.
NAMED_CASE = r"\b[A-Z][A-Za-z.&'-]+\s+v\.\s+[A-Z][A-Za-z.&'-]+\b|\b(?:In re|Ex parte|Matter of)\s+[A-Z][A-Za-z0-9.&' -]+\b"
REPORTER = r"(?i)\b\d+\s+(?:U\.?\s*S\.?|S\.?\s*Ct\.?|F\.?\s?\d?d|F\.?\s?Supp\.?\s?\d?d|U\.?\s*S\.?\s*C\.?|C\.?\s*F\.?\s*R\.?)\s+\d+\b"
AUTHORITY_SEEKING = r"(?i)\b(?:find|identify|what|which|any|examples?|authorit(?:y|ies)|cases?|precedent|doctrine|rule|standard|test|factors?|relevant|involving|address(?:es|ing)?|discuss(?:es|ing)?|deals?\s+with|appl(?:y|ies|ication))\b"
AUTHOR_QUESTION = r"(?i)\bwho\s+(?:wrote|authored|joined|dissented|concurred)|\bwhich\s+justice\b|\bauthor\b"
HOLDING_QUESTION = r"(?i)\b(?:hold|holding|held)\b"
POSTURE_QUESTION = r"(?i)\b(?:what\s+did\s+(?:the\s+)?(?:supreme\s+)?court\s+do|what\s+happened|disposition|outcome|procedural\s+posture|case\s+posture)\b"
LEADS_QUESTION = r"(?i)\b(?:find\s+(?:me\s+)?(?:some\s+)?cases?|identify\s+(?:some\s+)?(?:cases?|authorit(?:y|ies)|precedent)|what\s+cases?\s+(?:discuss|address|talk\s+about|deal\s+with|involve)|which\s+cases?\s+(?:discuss|address|talk\s+about|deal\s+with|involve)|cases?\s+(?:about|on|involving|discussing|addressing)|case\s+law\s+(?:about|on|for|involving|discussing|addressing)|authorit(?:y|ies)\s+(?:about|on|for|involving|discussing|addressing)|precedent\s+(?:about|on|for|involving|discussing|addressing)|research\s+leads?|examples?\s+of)\b"
ISSUE_QUESTION = r"(?i)\b(?:whether|why|how|reason|analysis|say\s+about|explain|rule|factor|factors|consider|apply|application|mean|means|argue|argued)\b"
TOPIC = r"(?i)\b(?:law|property|contract|tort|criminal|constitutional|statutory|adverse\s+possession|easement|title|possession|negligence|damages|jurisdiction|standing|due\s+process|first\s+amendment|fourth\s+amendment|supervised\s+release|sentencing|habeas|brady|materiality|fraud|tariff|agency)\b"
FOLLOW_UP = r"(?i)\b(?:that|this|it|its|the case|the court|the separate opinion|separate opinion|the dissent|the concurrence|same case|that case|that opinion)\b"
CASE_NAME = r"\b([A-Z][A-Za-z0-9&'.-]*(?:\s+[A-Z][A-Za-z0-9&'.-]*){0,7}\s+v\.\s+[A-Z][A-Za-z0-9&'.-]*(?:\s+[A-Z][A-Za-z0-9&'.-]*){0,7})\b"
US_CITATION = r"(?i)\b\d+\s+U\.?\s*S\.?\s+(?:\d+|_{2,})(?:\s*\(\d{4}\))?"
DEPTH_QUESTION = r"(?i)\b(?:bullet(?:ed|s)?|list|paragraphs?|explain|why|reason(?:ing|s)?|practical|takeaways?|compare|comparison|in[-\s]?depth|detail(?:ed|s)?|outline|walk\s+through|what\s+is\s+the\s+(?:rule|standard|test))\b"

# Patterns of claims and sentences.
STATUTE = r"(?i)\b\d+\s+U\.?\s*S\.?\s*C\.?\b"
CITED = r"\b\d+\s+U\.?\s*S\.?\s+\d+\b"
HELD = r"(?i)\b(?:held|hold|ruled|found|concluded|determined|vacated|affirmed|reversed)\b"
HEDGED = r"(?i)\b(?:may|might|could|possibly|likely|arguably|appears|suggests)\b"
LOW_VALUE = r"(?i)^\s*(?:so too here|same here|for these reasons|for that reason|that is enough|that resolves the question|\*+|insufficient support in retrieved authorities.*|retrieved authorities do not.*|retrieved context does not.*|cannot determine from (?:the )?retrieved.*|i do not have .+ in the retrieved database.*|the uploaded document excerpt does not identify .*)\.?\s*$"
FRAGMENT = r"""(?i)^\s*(?:[A-Z]\.|[A-Z]\.\s*[A-Z]\.|["'“”.,;:]+\.?|v\.\s+[^.]+\.?|(?:see\s+)?id\.,?.*|[A-Z][a-z]+,\s+and\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\.?|)\s*$"""
TRAILING_ABBREVIATION = r"(?i)\b(?:Mr|Mrs|Ms|Dr|Prof|Hon|Lt|No|Nos|Inc|Corp|Co|Ltd|L\.P|L\.L\.C|U\.S|U\.S\.C|D\.C|Cir|v)\.\s*$"
SINGLE_INITIAL = r"\b[A-Z]\.$"
INITIALS = r"(?:\b[A-Z]\.\s*){2,}$"
DANGLING = r"(?i)\b(?:and|or|but|because|that|which|who|whom|whose|when|where|while|with|without|to|of|for|from|by|as|just)\.$"
FINITE_VERB = r"(?i)\b(?:is|are|was|were|be|been|being|has|have|had|do|does|did|held|holds|hold|said|says|state|states|stated|found|finds|concluded|ruled|decided|affirmed|reversed|vacated|remanded|denied|granted|requires?|prohibits?|allows?|authorizes?|applies?|violates?|means?|seeks?|suffered|lacks?|lost|lists?|identifies?|overrules?|concerns?|addresses?|involves?|includes?|excludes?|must|may|can|cannot|could|should)\b"
RHETORICAL = r"(?i)\b(?:unfortunate|unfortunately|hope|hopes|hoped|the context suggests|in the meantime|more carefully consider|may soon)\b"
ATTRIBUTION = r"(?i)^([A-Z][\w .,'-]{1,120}?)\s+(alleges|alleged|argues|argued|claims|claimed|contends|contended|asserts|asserted|states|stated|testifies|testified|said)\s+that\s+(.+)$"
HOLDING_LEAD = r"(?i)^\s*(?:held:|the court (?:holds|held|agrees with|concludes)\b|we (?:hold|agree|conclude)\b|for the foregoing reasons, we conclude|therefore, the judgment|the judgment (?:of|below)|district courts cannot\b|may not\b|cannot\b|must\b|is not authorized to\b|authorizes?\b|does not authorize\b|does not violate\b|cannot be squared\b|need not evaluate\b|the preponderance-of-the-evidence standard applies\b|nothing in\b[^.!?]{0,120}\b(?:authorizes|enables|empowers)\b)"
HOLDING_CONCLUSION = r"(?i)\b(?:judgment[^.!?]{0,120}\b(?:affirmed|reversed|vacated|remanded)\b|decision[^.!?]{0,120}\b(?:affirmed|reversed|vacated|remanded)\b|must be (?:vacated|remanded|reversed|affirmed)\b|does not violate\b|cannot be squared\b|need not evaluate\b|preponderance-of-the-evidence standard applies\b|nothing in\b[^.!?]{0,120}\b(?:authorizes|enables|empowers)\b|did not grant\b[^.!?]{0,120}\b(?:power|authority)\b)"
FRAGMENT_START = r"(?i)^(?:is|are|was|were|and|or|to|from|because|that|which|who|whom|whose|when|where|while|with|without|by|as|just|also|even|still|yet|but|however|therefore|thus|hence|moreover|furthermore|nevertheless|nonetheless|otherwise|instead|meanwhile|afterward|before|after|during|since|until|unless|although|though|whereas)\b"
TRUNCATED_END = r"(?i)(?:Mr|Mrs|Ms|Dr|Prof|Hon|Lt|Justice|No|Nos|Inc|Corp|Co|Ltd|v|U\.S|D\.C|Cir|U\.S\.C)$"
INCOMPLETE = r"(?i)(?:\bcase\s+No\.?$|\bNo\.?$|\bv\.?$|^\d+\s+[A-Z][A-Z\s.,'&-]+v\.?$)"
CAPTION = r"(?i)^\s*(?:on writ of certiorari to|certiorari to)\b"
LOWER_COURT = r"(?i)\b(?:district court|court of appeals|sixth circuit|federal circuit|CIT|court of international trade)\b"
NOT_AUTHORITATIVE = r"(?i)\b(?:(?:petitioners?|respondents?|party|government)\s+(?:argue|argued|contend|contended|claim|claimed)|dissent(?:ing)?\b|concurr(?:ing|ence)\b|(?:court of appeals|district court|lower court)\s+(?:held|concluded|reasoned|ruled)|rejected\s+(?:that|this|the)\s+(?:argument|view|contention|claim))"
POSTURE_CLAIM = r"(?i)\b(?:argue|argument|petitioner|respondent|dissent|concurr|court of appeals|district court|lower court)\b"

# Print noise in opinions.
PRINT_NOTICE = r"(?iU)\b(?:Page Proof Pending Publication|PRELIMINARY PRINT|OFFICIAL REPORTS OF THE SUPREME COURT|NOTICE: This preliminary print is subject to formal revision before publication)\b"
CITE_AS = r"(?iU)\bCite as:\s*[^.!?]{0,160}?\(\d{4}\)"
PAGE_HEADER = r"(?U)\b\d{1,4}\s+[A-Z][A-Z0-9.,'&\-\s]{2,90}\s+v\.\s+[A-Z][A-Z0-9.,'&\-\s]{1,90}\s+(?:Syllabus|Opinion of the Court|Slip Opinion|Per Curiam)\b"
PAGE_REFERENCE = r"(?U)\b(?:Pp?|pp)\.\s*\d+(?:[-–]\d+)?\b"

# Patterns of answer text outside claims.
CAVEAT = r"(?i)\b(?:insufficient support|retrieved context does not|retrieved authorities do not|not enough evidence|cannot determine|does not identify|no separate opinion identified|not available in the retrieved context|unclear from the retrieved|do not have .+ in the retrieved database)\b"
LABEL = r"(?i)^(?:(?:the\s+)?(?:holding|rule|legal\s+rule|core\s+holding)(?:\s+in\s+[^:\n]{1,160})?\s+(?:is|was)\s*:|(?:bottom\s+line|practical\s+takeaway|takeaway|practical\s+rule)\s*:)\s*$"
FACT_ANCHOR = r"(?i)(?:\b(?:supreme court|court|justice|judge|jury|petitioner|respondent|plaintiff|defendant|government|state|district court|court of appeals|held|holds|holding|concluded|found|ruled|decided|denied|granted|affirmed|reversed|vacated|remanded|certiorari|dissent|concurrence|opinion|judgment|statute|constitutional|amendment)\b|U\.?S\.?C\.?|U\.?S\.?|§|\bv\.)"
ANSWER_VERB = r"(?i)\b(?:is|are|was|were|has|have|had|held|holds|denied|granted|affirmed|reversed|vacated|remanded|concluded|found|ruled|requires?|prohibits?|allows?|authorizes?|violates?|applies?|means?)\b"
TRANSITION = r"(?i)^\s*(?:in short|put differently|in other words|overall|therefore|accordingly|as a result|the practical point|the bottom line|on that basis)\b[:,]?"
CONSTITUTIONAL = r"(?i)\b(?:(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|Twelfth|Thirteenth|Fourteenth|Fifteenth)\s+Amendment|Equal Protection Clause|Due Process Clause|Commerce Clause|Appointments Clause|Free Speech Clause|Establishment Clause|Takings Clause)\b"
