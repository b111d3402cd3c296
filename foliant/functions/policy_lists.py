"""Fixed values of the content policy: categories, phrases and patterns."""

# --- Fixed values: categories ---------------------------------------------------
CATEGORY_ORDER = ["self_harm", "sensitive_data", "prompt_injection", "security_bypass", "malicious_action"]
CATEGORY_MESSAGES = {
    "self_harm": (
        "I'm really sorry you're dealing with this. I can't help with instructions that could be used for self-harm. "
        "If you might act on these thoughts, call emergency services now. "
        "If you're in the U.S. or its territories, call or text 988 right now to reach the 988 Suicide & Crisis Lifeline. "
        "If you're elsewhere, contact your local emergency number or crisis line now. "
        "If you can, move the rope or other means away from you and get near another person while you reach out for help."
    ),
    "sensitive_data": "I cannot help reveal or extract real secrets, credentials, or private account data.",
    "prompt_injection": "I cannot expose hidden system prompts, internal instructions, or bypass the instruction hierarchy.",
    "security_bypass": "I cannot help bypass authentication or break through real security controls.",
    "malicious_action": "I cannot help with instructions for unauthorized access, phishing, malware, or data theft.",
}
BLOCKED_TEXT = "This request is blocked."
PURPOSE_CATEGORIES = {
    "user_query": CATEGORY_ORDER,
    "user_answer": CATEGORY_ORDER,
    "generated_content": CATEGORY_ORDER,
    "model_output": CATEGORY_ORDER,
    "retrieved_context": ["sensitive_data", "prompt_injection"],
}

# --- Fixed values: phrase lists -------------------------------------------------
ACCESS_ACTIONS = ["cat", "display", "dump", "expose", "extract", "give me", "leak", "list", "open", "print", "read",
                  "repeat", "reveal", "send me", "show me", "summarize", "tell me"]
DIRECT_REQUESTS = ["can you", "get me", "help me", "how do i", "how to", "i need", "show me", "walk me through"]
EDUCATIONAL_STARTS = ["analyze ", "compare ", "define ", "describe ", "discuss ", "explain ", "outline ", "summarize ",
                      "teach me ", "what are ", "what is ", "why is "]
EDUCATIONAL_HINTS = ["concept", "definition", "educational", "example", "examples", "for a lesson", "for class",
                     "overview", "the difference between", "what does it mean", "why is"]
CREATIVE_VERBS = ["compose", "create", "draft", "generate", "tell", "write"]
CREATIVE_NOUNS = ["dialogue", "fiction", "fictional", "narrative", "novel", "poem", "scenario", "scene", "story"]
SECRET_TARGETS = [".env", "access token", "api key", "auth token", "bank account", "bearer token", "connection string",
                  "credential", "credentials", "credit card", "cvv", "database uri", "database url", "debit card",
                  "environment variables", "env vars", "iban", "jwt", "national id", "passport number", "passcode",
                  "password", "pin", "private key", "recovery phrase", "refresh token", "routing number",
                  "seed phrase", "session cookie", "social security", "ssh key", "ssn", "swift"]
SYSTEM_SECRET_TARGETS = [".env", "access token", "api key", "auth token", "bearer token", "connection string",
                         "credential", "credentials", "database uri", "database url", "environment variables",
                         "env vars", "jwt", "private key", "recovery phrase", "refresh token", "seed phrase",
                         "session cookie", "ssh key"]
INTERNAL_TARGETS = ["developer message", "developer prompt", "developer notes", "hidden instructions", "hidden prompt",
                    "internal instructions", "internal prompt", "internal rules", "system instructions",
                    "system prompt"]
GUARDRAIL_TARGETS = ["filters", "guardrails", "policy", "safety"]
BYPASS_TERMS = ["2fa", "authentication", "bypass auth", "bypass authentication", "bypass login", "captcha",
                "credential stuffing", "disable mfa", "disable 2fa", "escalate privileges", "exploit",
                "exploit chain", "exploit kit", "login page", "mfa", "privilege escalation", "session hijack",
                "session fixation", "sql injection", "sqli", "token theft", "xss"]
INSTRUCTIONAL_HINTS = ["attack chain", "build a", "code for", "command to", "commands for", "give me code",
                       "give me steps", "how do i", "how to", "payload", "script", "step by step", "steps to",
                       "walk me through", "write code"]
MALICIOUS_TERMS = ["botnet", "credential theft", "data exfiltration", "exfiltrate data", "keylogger", "malware",
                   "phishing", "phishing email", "phishing kit", "ransomware", "rat", "remote access trojan",
                   "steal credentials", "steal passwords", "steal data", "trojan"]
BUILD_HINTS = ["create", "draft", "generate", "template", "write"]
REAL_TARGETS = [".env", "account", "admin panel", "company", "customer", "database", "production", "router", "server",
                "system", "vpn", "website", "wifi"]
EXFILTRATION_HINTS = ["download", "export", "steal", "copy", "exfiltrate"]
ARTIFACT_PHRASES = ["phishing email", "phishing kit", "keylogger", "payload", "script", "template"]
DISTRESS_HINTS = ["alone", "can't go on", "cant go on", "hopeless", "i am done", "i feel empty", "i give up", "lonely",
                  "no reason to live", "not safe", "worthless"]
MEANS_HINTS = ["blade", "bridge", "gun", "hang it", "hang myself", "hanging", "knife", "noose", "pills",
               "place to hang", "poison", "rope"]
METHOD_ASK_HINTS = ["help me", "how do i", "how to", "instructions", "show me", "step by step", "tie a rope",
                    "tie the rope", "what knot"]
BODY_HINTS = ["around my neck", "around the neck", "around your neck", "my neck", "neck", "throat"]
OUTPUT_HINTS = ["around your neck", "hang it", "hang yourself", "knot", "loop", "noose", "rope", "step 1",
                "step-by-step", "tie a rope"]
OUTPUT_DANGER_HINTS = ["around your neck", "hang it", "hang yourself", "noose"]

# --- Fixed values: patterns -----------------------------------------------------
OVERRIDE_PATTERNS = [
    r"(?:^|[.!?]\s*)(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above)\s+instructions\b",
    r"\b(?:jailbreak|do anything now|uncensored mode)\b",
    r"\bpretend you have no restrictions\b",
    r"\bno restrictions\b",
    r"\bno rules\b",
    r"\boverride\b.*\b(?:safety|guardrails|policy|filters)\b",
]
SECRET_PATTERNS = [
    r"\bsk-[A-Za-z0-9]{20,}\b",
    r"\bghp_[A-Za-z0-9]{30,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
]
EXPLICIT_HARM_PATTERNS = [
    r"\b(?:kill myself|end my life|take my life|commit suicide|suicide plan|want to die|don't want to live)\b",
    r"\b(?:hang myself|strangle myself|overdose|cut myself|hurt myself|harm myself)\b",
]
HARM_METHOD_PATTERNS = [
    r"\b(?:how\s+(?:do\s+i|to)|help me|show me|instructions?|steps?|step\s+by\s+step)\b.{0,90}\b(?:tie|knot|loop|noose|rope)\b.{0,90}\b(?:neck|throat|hang)\b",
    r"\b(?:tie|knot|loop|noose|rope)\b.{0,90}\b(?:around|fit|fits|tight|perfectly)\b.{0,90}\b(?:neck|throat)\b",
    r"\b(?:rope|noose|knot|loop)\b.{0,90}\b(?:so\s+i\s+(?:can|could|will|would)|to)\s+hang\b",
]
OUTPUT_METHOD_PATTERNS = [
    r"\b(?:tie|knot|loop|noose|rope)\b.{0,90}\b(?:neck|throat|hang|pull\s+tight)\b",
]
LIST_SHAPE_PATTERNS = [
    r"(?m)^\s*(?:\d+\.|[-*])\s+",
    r"\b(?:step\s+1|step\s+2|first,|next,|finally,)\b",
    r"\b(?:here is|here's)\s+(?:a\s+)?(?:simple\s+)?method\b",
]
