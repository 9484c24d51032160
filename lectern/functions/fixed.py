"""Fixed values.

Everything in this file is a value that results depend on: word lists, lookup
tables, limits, patterns and formats. None of it is logic.
"""

# ---- fixed values: query words ---------------------------------------------
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "and", "or", "in", "on", "for", "with",
    "that", "this", "it", "as", "at", "by", "from", "what", "how", "did", "does", "do", "can", "could",
    "would", "should", "will", "shall", "which", "who", "whom", "i", "you", "we", "they",
]

# ---- fixed values: upload formats ------------------------------------------
SUPPORTED_EXTENSIONS = [
    "pdf", "docx", "doc", "txt", "md", "markdown", "rtf", "odt", "csv", "tsv", "xlsx", "xls", "ods", "json",
    "yaml", "yml", "pptx", "ppt", "odp", "html", "htm", "xml", "svg", "png", "jpg", "jpeg", "webp", "gif",
    "tiff", "bmp", "zip", "eml", "msg", "py", "js", "jsx", "ts", "tsx", "java", "c", "cpp", "cs", "go", "rs",
    "php", "rb", "sql", "sh", "ps1", "css", "scss", "log", "ini", "cfg", "conf", "properties", "env",
    "example",
]

TEXT_EXTENSIONS = [
    "txt", "md", "markdown", "csv", "tsv", "json", "yaml", "yml", "xml", "html", "htm", "py", "js", "jsx",
    "ts", "tsx", "java", "c", "cpp", "cs", "go", "rs", "php", "rb", "sql", "sh", "ps1", "css", "scss", "env",
    "log", "ini", "cfg", "conf", "properties", "example",
]

MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "rtf": "application/rtf",
    "odt": "application/vnd.oasis.opendocument.text",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "json": "application/json",
    "yaml": "text/yaml",
    "yml": "text/yaml",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "html": "text/html",
    "htm": "text/html",
    "xml": "application/xml",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "gif": "image/gif",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "zip": "application/zip",
    "eml": "message/rfc822",
    "msg": "application/vnd.ms-outlook",
    "py": "text/x-python",
    "js": "text/javascript",
    "jsx": "text/javascript",
    "ts": "text/typescript",
    "tsx": "text/typescript",
    "java": "text/x-java-source",
    "c": "text/x-c",
    "cpp": "text/x-c++src",
    "cs": "text/x-csharp",
    "go": "text/x-go",
    "rs": "text/x-rustsrc",
    "php": "text/x-php",
    "rb": "text/x-ruby",
    "sql": "text/x-sql",
    "sh": "text/x-shellscript",
    "ps1": "text/plain",
    "css": "text/css",
    "scss": "text/x-scss",
    "log": "text/plain",
    "ini": "text/plain",
    "cfg": "text/plain",
    "conf": "text/plain",
    "properties": "text/plain",
    "env": "text/plain",
    "example": "text/plain",
}
DEFAULT_MIME = "application/octet-stream"

UNIT_LABELS = {
    "slides": ["pptx", "ppt", "odp"],
    "pages": ["pdf", "docx", "doc", "odt"],
    "sheets": ["xlsx", "xls", "ods"],
    "image": ["png", "jpg", "jpeg", "webp", "gif", "tiff", "bmp"],
    "archive": ["zip"],
    "email": ["eml", "msg"],
}
DEFAULT_UNIT = "document"

# ---- fixed values: limits ---------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
CHUNK_SIZE = 900
CHUNK_OVERLAP = 150
MIN_CHUNK_CHARS = 20
MIN_SEARCHABLE_CHARS = 20
EVIDENCE_TOKENS = 3500
CHARS_PER_TOKEN = 4
EVIDENCE_ROW_OVERHEAD = 30
RRF_K = 60
TOP_K = 25
HISTORY_TURNS = 10
SUMMARY_EVERY = 8
STALL_MINUTES = 15
MAX_ATTEMPTS = 3
MIN_RELEVANCE = 0.25
GROUNDING_SENTENCE = 0.12
GROUNDING_SHARE = 0.50
COVER_K = 16.0

# ---- fixed values: text cleaning patterns ----------------------------------
DATA_LINK = r"!?\[[^\]]*\]\(data:[^)]+\)"
DATA_IMAGE = r"data:image/[a-z0-9.+-]+;base64,[a-z0-9+/=]+"
BASE64_32 = r"[a-z0-9+/=]{32,}"
BASE64_160 = r"[a-z0-9+/=]{160,}"
DATA_LINK_LOOSE = r"!?(?:\[[^\]]*\])?\(data:[^)]+\)"
DATA_ANY = r"data:[a-z]+/[a-z0-9.+-]+;base64,[a-z0-9+/=\s]+"
CONTROL_CHARS = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]"
SCRIPT_BLOCK = r"(?s)<script.*?</script>"
STYLE_BLOCK = r"(?s)<style.*?</style>"
LAYOUT_TAG = r"</?(?:html|body|div|span|font)[^>]*>"
ANY_TAG = r"<[^>]+>"
PAGE_NUMBER_LINE = r"^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$"
ONE_GLYPH_LINE = r"^[\p{L}\p{N}&/.,:;()\-—]$"
PAGE_MARKER = r"<!-- PAGE \d+ -->"

# ---- fixed values: refusal wording -----------------------------------------
REFUSAL = (
    r"couldn't find sufficient information|i do not have enough information|"
    r"does not contain information|i cannot answer|no matching chunks found|"
    r"not mentioned in the provided|not covered in the provided|no information about this"
)
NO_EVIDENCE = (
    r"couldn't find sufficient information|i do not have enough information|"
    r"does not contain information|i cannot answer|no matching chunks found"
)
DELIVERY_NOTE = r"^Here is the \w+ you requested"
NO_EVIDENCE_ANSWER = "I couldn't find sufficient information about this in the uploaded documents."

# ---- fixed values: scope words ---------------------------------------------
CROSS_DOCUMENT = r"\b(across|all|compare)\b"
SEVERAL_SOURCES = r"\b(?:and|vs\.?|versus|between|across|compare)\b"
PROPER_TOPIC = (
    r"^(?:Explain|Describe|Define|Discuss|What is|Tell me about)\s+(?:the\s+)?"
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
)

# ---- fixed values: requested format, first match wins ----------------------
FORMAT_RULES = (
    ("pdf", r"\bpdf\b"),
    ("docx", r"\bdocx\b|\bmicrosoft\s+word\b|\bword\s+(?:file|document)\b"),
    ("xlsx", r"\b(xlsx|excel|spreadsheet)\b"),
    ("pptx", r"\b(pptx?|powerpoint|presentation|slides?)\b"),
    ("html", r"\b(html|web(?: ?page| document)?)\b"),
    ("csv", r"\b(csv)\b"),
    ("json", r"\b(json|structured data)\b"),
    ("md", r"\b(markdown|documentation)\b"),
    ("txt", r"\b(text file|plain text)\b"),
    ("svg", r"\b(svg|diagram|visuali[sz]e|visually|visual representation|architecture|workflow|process)\b"),
)
FILE_FORMATS = ["pdf", "docx", "pptx", "xlsx", "csv", "txt", "md", "html", "json", "svg"]
DELIVERY_VERB = (
    r"\b(?:give|create|generate|make|build|prepare|produce|convert|turn|export|download|save|"
    r"send|put|need|want|show|get|map)\b"
)
THEME_RULES = (
    ("executive", r"\b(management|leadership|executive|meeting)\b"),
    ("technology", r"\b(technical|architecture)\b"),
    ("minimal", r"\b(simple|minimal|clean)\b"),
    ("corporate", r"\b(corporate|business)\b"),
)
PALETTE_RULES = (
    ("monochrome", r"\b(black and white|monochrome)\b"),
    ("navy", r"\b(navy)\b"),
    ("green", r"\b(green)\b"),
    ("purple", r"\b(purple)\b"),
    ("orange", r"\b(orange)\b"),
    ("blue", r"\b(blue)\b"),
)
TEMPLATE_BY_THEME = {
    "executive": "executive_summary",
    "technology": "technical_report",
    "minimal": "simple_document",
}
VISUAL_RULES = (
    ("architecture", r"\b(architecture|system)\b"),
    ("timeline", r"\b(timeline|chronolog)\b"),
    ("decision_tree", r"\b(decision|branch)\b"),
    ("roadmap", r"\b(roadmap|milestone)\b"),
    ("process_flow", r"\b(process|flow|workflow|stage|step)\b"),
)

# ---- fixed values: turn tests ----------------------------------------------
PRONOUN = r"\b(this|that|it|these|those|the above|previous|current|selected document)\b"
SUMMARISE = (
    r"\b(summarize|summary|summarise|key points|bullet points|shorten|condense|rephrase|"
    r"rewrite|simplify|translate|professional)\b"
)
NEW_TOPIC = (
    r"\b(explain|describe|what|why|how|which|define|tell|compare) "
    r"(?!this|that|it|these|those|the above|previous|current)\b"
)
POINTERS = r"(?:this|that|it|these|those|the above|previous|current)"
CONTEXT_DIAGRAM = (
    r"\b(flow\s*(?:chart|diagram)|process\s*(?:flow|diagram)|workflow|diagram|visuali[sz]ation)\b"
)
CONTEXT_REFERENCE = (
    r"\b(?:based on|from|using|with)\s+(?:this|that|the|above|previous)\s+(?:information|answer|content|details|document)\b"
    r"|\b(?:based on|from|using|with)\s+(?:(?:the|above|previous|current)\s+)?(?:information|answer|content|details|document)\b"
    r"|\b(?:this|that|the above|previous)\s+(?:information|answer|content|details|document)\b"
)
ELABORATE_VERB = r"\b(?:explain|describe|detail|elaborate|expand|break\s+down|clarify)\b"
ELABORATE_TARGET = (
    r"\b(?:each|every|all|these|those|the above|previous|current)\s+"
    r"(?:feature|features|item|items|point|points|section|sections|capability|capabilities)\b"
)
KNOWLEDGE_VERB = r"\b(?:explain|describe|what|why|how|which|define|tell|list|identify|compare|analy[sz]e)\b"
DEICTIC = r"\b(?:this|that|it|these|those|above|previous|current)\b"
KNOWLEDGE_FILLER = (
    r"\b(?:explain|describe|what|why|how|which|define|tell|list|identify|compare|analy[sz]e|is|"
    r"are|the|a|an|of|in|about|for|please)\b"
)
ANSWER_REFERENCE = (
    r"\b(?:based on|from|using|with)\s+(?:this|that|the|above|previous|current)\s+(?:result|answer|response|summary|explanation|content|information|output)\b"
    r"|\b(?:based on|from|using|with)\s+(?:(?:the|above|previous|current)\s+)?(?:information|answer|response|summary|explanation|content|output)\b"
    r"|\b(?:this|that|the above|previous|current)\s+(?:result|answer|response|summary|explanation|content|information|output)\b"
    r"|\b(?:turn|convert|make|create|put|give|download|export|save)\b[^.?!]*\b(?:it|this|that)\b"
    r"|\b(?:download|export|save)\s+(?:this|that|the above|previous|current)\s+(?:result|answer|response|summary|explanation|content|information|output)\b"
    r"|\b(?:above|previous|current)\b"
    r"|\b(?:this|that)\s+(?:information|data|content|explanation|report|document|file)\b"
)
OUTPUT_WORDS = (
    r"\b(?:create|generate|make|build|prepare|produce|convert|turn|export|download|save|give|get|send|put|need|want|would|like|can|could)\b",
    r"\b(?:pdf|docx|word|pptx|powerpoint|presentation|xlsx|excel|spreadsheet|csv|txt|text|markdown|html|json|svg|diagram|flowchart)\b",
    r"\b(?:i|me|you|a|an|the|to|as|into|in|for|of|and|or|my|your|please|something|file|format|version|copy|report|document|data|information|content|answer|result|response|summary|explanation|professional|clean|management|executive|printable|editable|share)\b",
)
RETRIEVAL_NOISE = (
    r"\b(?:create|generate|make|build|prepare|produce|convert|turn|export|download|save|give|send)\b",
    r"\b(?:a|an|the|this|that|it|me|please)\b",
    r"\b(?:pdf|docx|word|pptx|powerpoint|presentation|xlsx|excel|spreadsheet|csv|txt|text|markdown|html|json|svg|diagram)\b",
    r"\b(?:file|format|version|copy|report|document|to download|for download)\b",
)
TOPIC_NOISE = (
    r"\b(?:explain|describe|summari[sz]e|tell me about|what (?:is|are)|list|show|give me|outline|detail)\b",
    r"\b(?:in|from|within|about|regarding|the|a|an)\b",
)
CREATION_VERB = r"\b(create|generate|make|build|prepare|produce|convert|turn|export|format)\b"
FETCH_VERB = r"\b(download|retrieve|send)\b"
SHARE_VERB = r"\b(download|send|share)\b"
NAMED_SUBJECT = r"\b(about|regarding|on)\s+\w+"
KNOWLEDGE_REQUEST = (
    r"\b(explain|describe|summari[sz]e|tell|what|why|how|which|compare|analy[sz]e|outline|detail|list|identify)\b"
)
TRANSFORM_REQUEST = (
    r"\b(summarize|summarise|rewrite|rephrase|organize|prepare|present|print|editable|convert|"
    r"turn|make|show|give me|need something)\b"
)
DEICTIC_CONVERSION = (
    r"\b(?:convert|turn|make|transform|change|put|export|show|render)\s+(?:this|that|it)\b"
    r"|\b(?:this|that|it)\s+(?:into|to|as|in(?:to)?)\b"
    r"|\b(?:make|turn)\s+(?:this|that|it)\s+(?:a|an|the)\b"
    r"|\bnow\s+(?:make|show|convert|turn|put)\b"
)
FOLLOW_UP = (
    r"\b(this|that|it|these|those|above|previous|same)\b"
    r"|\b(more content|more detail|make it|summarize|summarise|bullet|professional)\b"
)
CHART_WORD = r"\b(chart|graph|plot|visual|visualize|visualization)\b"
CHART_POINTER = r"\b(previous|last|that|the|current)\b"
WORD_COUNT = r"\b(?:in|within|under|about|around|exactly|just)?\s*(\d{1,4})\s*words?\b"

# ---- fixed values: resolver schema -----------------------------------------
RESOLVER_REQUIRED = [
    "contextRelation", "contextType", "resolvedAnswerId", "resolvedArtifactId", "intent",
    "requestedFormat", "topic", "confidence", "newInformationRequired",
]
RESOLVER_OPTIONAL = ["visualType", "theme", "palette", "template", "outputs", "targetDocument", "pointCount"]
RELATIONS = ["CONTINUE", "TRANSFORM", "MODIFY", "REPRESENT", "DOWNLOAD", "NEW_TOPIC", "MULTI_TOPIC", "NONE"]
CONTEXT_TYPES = ["CURRENT_ANSWER", "NEW_TOPIC", "NONE"]
INTENTS = ["ANSWER", "SUMMARY", "CREATE", "CONVERT", "VISUALIZE", "DOWNLOAD", "CREATE_AND_DOWNLOAD", "MODIFY"]
RESOLVER_FORMATS = ["PDF", "DOCX", "PPTX", "XLSX", "CSV", "SVG", "TXT", "MD", "HTML", "JSON"]
RESOLVER_VISUALS = [
    "process_flow", "organization_chart", "timeline", "architecture", "hierarchy", "comparison",
    "decision_tree", "roadmap", "mind_map",
]
RESOLVER_THEMES = [
    "professional", "corporate", "executive", "technology", "finance", "healthcare", "education",
    "minimal", "modern", "technical",
]
RESOLVER_PALETTES = [
    "blue", "blue_teal", "navy", "green", "purple", "orange", "monochrome", "professional_blue",
    "navy_blue", "corporate_gray", "executive_black_gold", "technology_blue", "finance_green",
    "healthcare_blue", "education_purple", "minimal_monochrome",
]
RESOLVER_TEMPLATES = [
    "professional_report", "executive_summary", "client_report", "technical_report",
    "business_proposal", "case_study", "meeting_summary", "project_report", "presentation",
    "simple_document",
]

# ---- fixed values: terms of the search that needs only one of them ---------
OR_TERMS = 8

# ---- fixed values: diagram schema ------------------------------------------
DIAGRAM_TEMPLATES = [
    "organization_chart", "process_flow", "workflow", "timeline", "architecture", "hierarchy",
    "comparison", "decision_tree", "roadmap", "mind_map",
]
DIAGRAM_THEMES = [
    "professional", "corporate", "executive", "technology", "finance", "healthcare", "education",
    "minimal", "modern",
]
DIAGRAM_PALETTES = [
    "blue", "blue_teal", "navy", "green", "purple", "orange", "monochrome", "custom", "auto",
]
MAX_NODES = 50
MAX_EDGES = 100

# ---- fixed values: answer sentences that carry no claim --------------------
INTRO_SENTENCE = (
    r"^(here is|the following|summary of|below is|this document|in summary|based on|according to|the case stud)"
)
LABEL_SENTENCE = r"^[A-Z][a-z]+\s+(Management|Access|Search|Security|Control)\b"
SOURCE_NOTE_ROUND = r"\(\s*source\s*:\s*[^)]+\)"
SOURCE_NOTE_SQUARE = r"\[\s*source\s*:\s*[^\]]+\]"

# ---- fixed values: mis-decoded punctuation and what it stood for -----------
# UTF-8 punctuation read as Windows-1252 twice over, once, and what it was.
MOJIBAKE = [
    ("Ã¢â‚¬â€\x9d", "â€”", "—"),
    ("Ã¢â‚¬â€œ", "â€“", "–"),
    ("Ã¢â‚¬â„¢", "â€™", "’"),
    ("Ã¢â‚¬Å“", "â€œ", "“"),
    ("Ã¢â‚¬Â\x9d", "â€\x9d", "”"),
    ("Ã¢â‚¬Â¦", "â€¦", "…"),
]
# A closing quote that lost its unprintable last byte.
CUT_QUOTE = ("â€", "”")
