"""Values the results depend on, kept in one place."""

# ---------------------------------------------------------------------------------------------------------
# A run gives the expected results only with exactly these.
# ---------------------------------------------------------------------------------------------------------
MIN_CALL_TOKENS = 15            # a call is scored when it has MORE tokens than this
MIN_SENTENCE_WORDS = 5          # a sentence is kept when it has AT LEAST this many words
CHUNK_CHARS = 4096
CHUNK_OVERLAP = 50
CHUNK_SEPARATORS = ("\n\n", "\n", " ", "")
SUMMARY_WORD_LIMIT = 150        # summaries and action lists stay UNDER this many words
COSINE_THRESHOLD = (2, 5)       # 0.4 as a fraction, so that it can be tested without rounding; strict ">"
TOP_TOPICS = 10
RUN_DATE_FORMAT = "yyyy_MM_dd"

NO_ACTIONS = "no actions taken generated"
NO_SUMMARY = "no summary generated"
ERROR_PREFIX = "Error: "
UNIDENTIFIED = "Unidentified"
NO_SECONDARY = "None"
NULL_LIST_ERROR = "'NoneType' object is not iterable"
NULL_TEXT_ERROR = 'can only concatenate str (not "NoneType") to str'

SUMMARY_PROMPT_HEAD = (
    "\n[INST] <<SYS>> Summarize the key discussion points between the customer and agent in under 150 words."
    "\n<<SYS>> "
)
ACTIONS_PROMPT_HEAD = (
    "\n[INST] <<SYS>> For each conversation, analyze the interaction between the customer and the agent. "
    "Identify and return a detailed list of the specific steps or actions taken by the agent to address and "
    "resolve the customer's query or issue in under 150 words."
    "\n<<SYS>> "
)
PROMPT_TAIL = " [/INST]\n"
# ---------------------------------------------------------------------------------------------------------

AGENT_ROLE = "assistant"        # the role of the agent's utterances

# Character classes, valid in Java and in RE2. BLANK is the set str.split() splits on.
BLANK = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
WORD_CHAR = r"\p{L}\p{M}\p{N}_"
TOKEN_PATTERN = rf"[{WORD_CHAR}]+|[^{BLANK}{WORD_CHAR}]"
TERM_PATTERN = rf"[{WORD_CHAR}]+"
WORD_PATTERN = rf"[^{BLANK}]+"
EDGE_BLANK_PATTERN = rf"^[{BLANK}]+|[{BLANK}]+$"

# Physical bounds. None of them changes a result; they choose between two exact ways of computing it.
SEGMENT_TURNS = 4096                    # turns of one call that are concatenated in one group
MAX_BROADCAST_BYTES = 8 * 1024 * 1024   # a catalogue up to this size is broadcast
TERM_SALTS = 16                         # spread of one term when the catalogue is too big to broadcast
