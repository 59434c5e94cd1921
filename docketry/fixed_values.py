"""Fixed values.

Every constant in this module is a fixed value of the data model: word lists,
patterns, prompts, limits and lookup rows that results depend on. They are
stated here as plain text and are not meant to be tuned.
"""

# --- columns a decision corpus has to provide -------------------------------
REQUIRED_COLUMNS = ["name_en", "document_date_en", "url_en", "unofficial_text_en"]

# --- sizes and limits ---------------------------------------------------------
SNIPPET_LENGTH = 500
DEV_ROW_LIMIT = 500
CHUNK_SIZE = 500
CHUNKED_WRITE_THRESHOLD = 1000
BATCH_MAX_ITEMS = 64
BATCH_TARGET_TOKENS = 65536
EMBED_MAX_CHARS = 32768
CHARS_PER_TOKEN = 4
LANDSCAPE_SIZE = 3

# --- authority scoring ---------------------------------------------------------
RECENCY_HALF_LIFE_YEARS = 7.0
UNKNOWN_DATE_FACTOR = 0.5
RECENT_MAX_YEARS = 5
OLDER_MAX_YEARS = 12
UNKNOWN_AGE = 999
HIGH_RELEVANCE = 0.65
MEDIUM_RELEVANCE = 0.35
GROUNDING_BASE = 0.75
GROUNDING_ANALYSIS = 0.05
GROUNDING_CITATION_STEP = 0.01
GROUNDING_REASONING_STEP = 0.02
GROUNDING_PART_CAP = 0.10
OUTCOME_SCAN_CHARS = 800

YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"
ANALYSIS_PATTERN = r"\banalysis\b"
CITATION_PATTERN = (
    r"\b(section \d+|s\.\s*\d+|the act|regulation|canada pension plan"
    r"|employment insurance act|minister|tribunal)\b"
)
REASONING_PATTERNS = [
    r"\bi find\b",
    r"\btherefore\b",
    r"\bthe evidence\b",
    r"\bi am (satisfied|not satisfied)\b",
    r"\bthe (law|test|criteria)\b",
    r"\bi (conclude|am persuaded)\b",
]
# For each reasoning pattern, words of which a match has to contain one.
REASONING_WORDS = [
    ["i find"],
    ["therefore"],
    ["the evidence"],
    ["satisfied"],
    ["the law", "the test", "the criteria"],
    ["i conclude", "i am persuaded"],
]
ALLOWED_PATTERN = r"\bappeal is allowed\b"
DISMISSED_PATTERN = r"\bappeal is dismissed\b"

# --- document structure ----------------------------------------------------------
CONTENT_MARKER = "Decision Content"
CONTENTS_LINE = "On this page"
BRIDGE_LINE = "Reasons and decision"
FOOTNOTE_START = "\nFootnote 1\n"
HEADING_PATTERN = r"[A-Z][A-Za-z][A-Za-z \-–—,/']{0,80}?"
PARAGRAPH_PATTERN = r"\[\d+\]"
PRIORITY_PATTERNS = [
    r"analysis|law and analysis",
    r"issue|issues|what i have to decide|what i must decide|what the .* must prove",
    r"conclusion|decision",
    r"overview|introduction|background",
    r"the law|applicable law|what the law says|legal framework",
    r"evidence|submissions|what the .* says",
]
DEFAULT_PRIORITY = 7
WHOLE_BODY_NAME = "body"
SECTION_SEPARATOR = "\n\n"
GAP_MARK = " [...] "

# --- prompts ------------------------------------------------------------------------
EMBEDDING_INSTRUCTION = (
    "Represent this query for retrieving similar Canadian "
    "administrative legal tribunal decisions"
)
RERANKER_INSTRUCTION = (
    "Given a legal query describing an appellant's situation, "
    "retrieve relevant Social Security Tribunal of Canada decisions"
)
# What the models expect around a text.
EMBED_LAYOUT = ["Instruct: ", "\nQuery:"]
RERANK_LAYOUT = ["<Instruct>: ", "\n<Query>: ", "\n<Document>: "]
CARD_LAYOUT = [
    "<|im_start|>system\n",
    "<|im_end|>\n<|im_start|>user\nHere is the tribunal decision:\n\n",
    "<|im_end|>\n<|im_start|>assistant\n",
]
CARD_PROMPT = (
    "You are a legal-aid assistant. Read the tribunal decision below and "
    "produce a plain-language summary a self-represented person can understand. "
    "Output EXACTLY four sections with these headings:\n\n"
    "**Issue:** (What legal question was the tribunal deciding?)\n"
    "**Key Facts:** (What were the most important facts?)\n"
    "**Test Applied:** (What legal test or criteria did the tribunal use?)\n"
    "**Outcome:** (What did the tribunal decide, and why?)\n\n"
    "Be concise. Use simple language. Do not invent facts."
)
GROUNDED_CARD_PROMPT = (
    "You are a legal-aid assistant. Read the tribunal decision below and "
    "produce a GROUNDED plain-language summary. Every factual claim must be "
    "traceable to the source text.\n\n"
    "Output EXACTLY four sections with these headings:\n\n"
    "**Issue:** (What legal question was the tribunal deciding?)\n"
    "**Key Facts:** (What were the most important facts?)\n"
    "**Test Applied:** (What legal test or criteria did the tribunal use?)\n"
    "**Outcome:** (What did the tribunal decide, and why?)\n\n"
    "IMPORTANT FORMATTING RULES:\n"
    "- Write each key claim as a bullet point starting with '- '\n"
    "- After each claim, add a source line on the next line:\n"
    "  [Source: para X-Y | explicit] if the decision directly states this\n"
    "  [Source: para X-Y | inferred] if you are drawing a reasonable inference\n"
    "- 'para' numbers refer to the paragraph position in the decision text "
    "(count from the start of the document, roughly by line breaks)\n"
    "- If a claim cannot be tied to a specific paragraph, write:\n"
    "  [Source: general context | inferred]\n"
    "- Do NOT invent facts. If something is unclear, say so.\n"
    "- Use simple language a non-lawyer can understand.\n\n"
    "Example format:\n"
    "**Key Facts:**\n"
    "- The appellant worked as a truck driver for 12 years before his injury.\n"
    "  [Source: para 3-4 | explicit]\n"
    "- His doctor believes he cannot return to physical labour.\n"
    "  [Source: para 8 | explicit]\n"
    "- He may have the ability to do sedentary work with retraining.\n"
    "  [Source: para 15-16 | inferred]\n"
)

# --- summary cards -------------------------------------------------------------------
CARD_HEADS = ["Issue", "Key Facts", "Test Applied", "Outcome"]
HIDDEN_BLOCK_PATTERN = r"<think>.*?</think>"
CONFIDENCE_LEVELS = ["explicit", "inferred"]

# --- messages --------------------------------------------------------------------------
STATUS_MESSAGES = {
    "no_candidates": "No similar cases were found for this query.",
    "none_after_rerank": "No sufficiently relevant cases were found after reranking.",
}

# --- glossary: (term, definition, context) -----------------------------------------
GLOSSARY = [
    (
        "just cause",
        "A legally acceptable reason for doing something. In employment "
        "law, it means circumstances where a reasonable person in the same "
        "situation would have had no other realistic choice.",
        "In EI cases, 'just cause' determines whether you had a valid "
        "reason for leaving your job voluntarily. The Tribunal asks: was "
        "leaving the only reasonable option given all the circumstances?",
    ),
    (
        "voluntary leaving",
        "When an employee chooses to leave their job on their own, rather "
        "than being fired or laid off. This can include resigning, quitting, "
        "or refusing to continue working.",
        "If you left your job voluntarily without 'just cause,' you may be "
        "disqualified from receiving EI benefits. The Tribunal looks at all "
        "the circumstances to decide if leaving was your only reasonable option.",
    ),
    (
        "severe and prolonged disability",
        "A disability that prevents you from regularly doing any type of "
        "substantially gainful work and is long-term or likely to result "
        "in death.",
        "To qualify for CPP Disability benefits, your disability must be "
        "both 'severe' (you can't regularly do any substantially gainful "
        "work) AND 'prolonged' (it is long-continued and of indefinite "
        "duration, or is likely to result in death).",
    ),
    (
        "minimum qualifying period",
        "The date by which you must prove your disability existed. It is "
        "calculated based on how long you contributed to the Canada "
        "Pension Plan.",
        "For CPP-D, you must show your disability was severe and prolonged "
        "on or before your MQP. If your MQP has passed, you need to prove "
        "you were already disabled by that date.",
    ),
    (
        "balance of probabilities",
        "The standard of proof in civil and administrative cases. It means "
        "'more likely than not' -- greater than a 50% chance that something "
        "is true.",
        "The Tribunal decides cases on the 'balance of probabilities,' not "
        "'beyond a reasonable doubt.' You need to show it is more likely "
        "than not that you meet the legal requirements.",
    ),
    (
        "misconduct",
        "Behaviour by an employee that is deliberate, wilful, or so "
        "reckless that it amounts to wilful disregard of the employer's "
        "interests.",
        "If you were fired for 'misconduct' under the EI Act, you may be "
        "disqualified from benefits. The Tribunal must decide whether your "
        "actions were wilful or so careless they were essentially deliberate.",
    ),
    (
        "substantially gainful",
        "Work that provides a meaningful income and requires significant "
        "physical or mental effort. Not just any small or occasional task.",
        "For CPP-D, 'severe' disability means you cannot regularly pursue "
        "any 'substantially gainful occupation.' The Tribunal considers "
        "whether you can realistically hold a job that pays a livable wage.",
    ),
    (
        "availability for work",
        "Being ready, willing, and able to work each working day. You "
        "must also be actively looking for a suitable job.",
        "To receive EI benefits, you must prove you were 'available for "
        "work.' The Tribunal looks at whether you had a genuine desire to "
        "work, made reasonable job search efforts, and had no personal "
        "conditions that would prevent you from accepting a job.",
    ),
    (
        "real and substantial connection",
        "A meaningful and genuine link between two things -- often between "
        "your reason for leaving a job and the actual departure.",
        "In EI voluntary leaving cases, the Tribunal checks whether there "
        "is a 'real and substantial connection' between your stated reason "
        "for quitting and your decision to leave when you did.",
    ),
    (
        "de novo hearing",
        "A completely fresh hearing where the Tribunal considers the case "
        "from scratch, as if no previous decision had been made.",
        "Appeals at the SST General Division are usually 'de novo,' meaning "
        "the Tribunal member makes their own independent decision based on "
        "all the evidence, not just whether the original decision was wrong.",
    ),
    (
        "retroactive benefits",
        "Benefits paid for a period before the date of the application "
        "or decision. Back-payment for time you were already eligible.",
        "If you applied late for CPP-D or OAS, you may receive retroactive "
        "benefits for up to a certain number of months before your "
        "application date, depending on the program rules.",
    ),
    (
        "suitable employment",
        "A job that is reasonable for you to accept given your skills, "
        "experience, health, location, pay expectations, and personal "
        "circumstances.",
        "For EI, refusing a 'suitable employment' offer can lead to "
        "disqualification. The Tribunal weighs factors like distance, "
        "working conditions, pay, and your qualifications to decide "
        "whether a job was suitable for you.",
    ),
]
