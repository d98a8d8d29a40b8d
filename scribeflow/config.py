"""Model tables, thresholds and cleaning patterns.

Patterns are written for Java's regular expressions: possessive groups instead of
greedy ones (long runs do not exhaust the stack), ``\\z`` for the end of a text and
``(?U)`` where white space includes the ideographic space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: file formats -------------------------------------------------
AUDIO_EXTENSIONS = ("mp3", "m4a", "wav", "flac", "ogg", "aac")
VIDEO_EXTENSIONS = ("mp4", "m4v", "mov", "avi", "mkv", "webm")
MIME_TYPES = {
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "m4v": "video/x-m4v",
    "m4a": "audio/mp4",
    "wav": "audio/wav",
    "flac": "audio/flac",
    "aac": "audio/aac",
    "ogg": "audio/ogg",
    "webm": "video/webm",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mkv": "video/x-matroska",
}
DEFAULT_MIME = "audio/mpeg"
SAMPLE_RATE = 16000
FRAME_SAMPLES = 480

# --- Fixed values: characters per token -------------------------------------------
CHARS_PER_TOKEN = {"en": 4.0, "ja": 1.4, "zh": 1.15, "ko": 1.5, "auto": 2.5}
CHARS_PER_TOKEN_OTHER = 3.0
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "ja": ("ja", "jpn", "japanese"),
    "zh": ("zh", "zho", "chinese", "zh-cn", "zh-tw"),
    "ko": ("ko", "kor", "korean"),
    "auto": ("auto", "mixed"),
}
# Safety factor and least tokens of an answer, by language; the cap for all.
ANSWER_TOKENS = {"ja": (1.5, 8192), "en": (1.3, 4096), "zh": (1.5, 8192), "ko": (1.5, 8192), "auto": (1.4, 6144)}
ANSWER_TOKENS_OTHER = (1.4, 6144)
MAX_ANSWER_TOKENS = 32768
MAX_SEGMENT_CHARS = {"ja": 15000, "en": 40000, "zh": 12000, "ko": 15000, "auto": 40000}
CHUNK_TOKEN_LIMITS = {"gpt-4o-mini": 3000, "gpt-4o": 4000, "gpt-3.5-turbo": 2500, "claude-3-haiku": 3500, "claude-3-sonnet": 4000, "gemini-pro": 3000}
CHUNK_TOKEN_FACTORS = {"ja": 0.8, "zh": 0.85, "ko": 0.9, "en": 1.0, "auto": 0.9}

# --- Fixed values: error words, tried in this order -------------------------------
ERROR_WORDS = {
    "api": ("api key", "apikey", "unauthorized", "401", "403", "invalid_api_key", "authentication", "quota", "rate limit"),
    "file": ("file not found", "no such file", "permission denied", "file size", "unsupported format", "corrupted", "invalid file"),
    "network": ("network", "connection", "timeout", "fetch", "cors", "failed to fetch", "net::", "dns"),
    "audio": ("audio", "decode", "web audio", "audiocontext", "unsupported audio", "media"),
    "size": ("size exceeds", "too large", "file size", "limit exceeded", "maximum", "exceeds limit"),
}

# --- Fixed values: dictionary limits ------------------------------------------------
MAX_DEFINITE, MAX_CONTEXTUAL, MAX_PLAIN_RULES, DEFAULT_PRIORITY = 50, 150, 20, 3

# --- Fixed values: models -----------------------------------------------------------


@dataclass(frozen=True)
class ModelPlan:
    """Chunking, merging and price of a speech model."""

    model: str
    pipeline: str
    chunk_seconds: float
    overlap_seconds: float
    variance_seconds: float
    min_silence: float
    force_after: float
    max_concurrency: int
    rate_delay_ms: int
    context_window: int
    cost_per_minute: float
    max_file_mb: float = 25.0
    max_duration: float = float("inf")
    min_chunk: float = 0.1
    chars_per_second: float = 15.0
    min_overlap: int = 150
    max_overlap: int = 500
    search_range: int = 2000
    step: int = 10
    similarity: float = 0.85
    duplicate_window: float = 30.0
    overlap_threshold: float = 0.5
    min_match: int = 20


MODELS = {
    "whisper-1": ModelPlan("whisper-1", "whisper", 25, 5, 5, 0.5, 3, 2, 3000, 0, 0.006),
    "whisper-1-ts": ModelPlan("whisper-1-ts", "whisper", 25, 5, 5, 0.5, 3, 2, 3000, 0, 0.006),
    "gpt-4o-transcribe": ModelPlan("gpt-4o-transcribe", "gpt4o", 300, 30, 60, 1.0, 30, 1, 0, 500, 0.006, max_duration=1500, min_overlap=40, search_range=800, similarity=0.78),
    "gpt-4o-mini-transcribe": ModelPlan("gpt-4o-mini-transcribe", "gpt4o", 240, 30, 60, 0.8, 20, 1, 0, 500, 0.003, max_duration=1500, min_overlap=40, search_range=800, similarity=0.78),
}
DEFAULT_CLEANING_MODEL = "gpt-4o-mini-transcribe"


def model_plan(model: str) -> ModelPlan:
    """The plan of a model; an unknown one is an error."""
    if model not in MODELS:
        raise KeyError(f"unknown model {model!r}")
    return MODELS[model]


# --- Fixed values: cleaning patterns, in order of use --------------------------------
# (pattern, limit): the share of the original that the pattern may remove at once;
# "repeat" patterns have no limit, "phrase" patterns the model's.
REPEAT, PHRASE = "repeat", "phrase"
KANA_SWITCH = "short-kana"
_RUN = [
    ("ja", ["ありがとうございます", "ありがとうございました", "ありがとう", "すみません", "はい", "お願いします"], 8),
    ("ja", ["うん", "そう", "まあ", "やばい"], 20),
    ("ko", ["감사합니다", "고맙습니다", "네", "아니요", "죄송합니다"], 8),
    ("ko", ["음", "어", "그"], 20),
]


def _runs(language: str) -> list[tuple[str, str]]:
    return [(f"(?U)(?:{w}[。、]?+\\s*+){{{n},}}+", REPEAT) for lang, words, n in _RUN if lang == language for w in words]


ARTEFACT_PATTERNS = {
    "ja": [
        *_runs("ja"),
        (KANA_SWITCH, REPEAT),
        ("ご視聴ありがとうございました。?\\z", PHRASE),
        ("チャンネル登録お願いします。?\\z", PHRASE),
        ("\\[音楽\\]", PHRASE),
        ("♪～", PHRASE),
        ("(?U)[・\\s]{20,}+", REPEAT),
        ("(?U)\\s*+・\\s*+・\\s*+・\\s*+・\\s*+・[^\\n\\r\\u2028\\u2029]*+\\z", PHRASE),
    ],
    "en": [
        ("(?iU)(?:Thank you\\.?+\\s*+){5,}+", REPEAT),
        ("(?iU)(?:Okay\\.?+\\s*+){5,}+", REPEAT),
        ("Thanks for watching\\.?", PHRASE),
        ("Please subscribe\\.?", PHRASE),
        ("(?i)\\[Music\\]", PHRASE),
        ("(?i)\\[Applause\\]", PHRASE),
    ],
    "zh": [
        ("(?U)(?:谢谢。?+\\s*+){5,}+", REPEAT),
        ("(?U)(?:好的。?+\\s*+){5,}+", REPEAT),
        ("感谢收看。?", PHRASE),
        ("请订阅。?", PHRASE),
        ("\\[音乐\\]", PHRASE),
    ],
    "ko": [
        *_runs("ko"),
        ("구독해주세요\\.?", PHRASE),
        ("시청해주셔서 감사합니다\\.?", PHRASE),
        ("\\[음악\\]", PHRASE),
        ("\\[박수\\]", PHRASE),
    ],
}
META_BRACKETS = "(?iu)\\[(?:音楽|拍手|笑い|Music|Applause|音声|雑音|無音)\\]"
ANY_TAG = "</?[\\p{L}\\p{N}_-]{1,16}[^>]*?>"
ENDINGS = {"ja": "[。、]", "en": "[.,!?]", "zh": "[。，！？]", "ko": "[.!?]"}
PARTICLES = ("は", "が", "を", "に", "の", "で", "と", "から", "まで", "より", "へ", "も", "や", "か")
EXPRESSIONS = ("その", "この", "あの", "って", "ので", "けど", "だけど", "でも", "まあ", "ちょっと")
PHRASE_RANGES = ((5, 10, 3), (10, 20, 2), (20, 30, 2))
INSTRUCTIONS = (
    "以下の音声内容のみを文字に起こしてください。",
    "この指示文は出力に含めないでください。",
    "音声内容のみを文字に起こしてください。",
    "指示文は出力に含めないでください。",
    "前回の内容や指示文は出力に含めないでください。",
    "話者の発言内容だけを正確に記録してください。",
    "正確に文字起こしを行ってください。",
    "適切な句読点を追加し、段落分けを行ってください。",
    "読みやすいように段落分けを行ってください。",
    "Please transcribe the following audio.",
    "Do not include this instruction in the output.",
    "Transcribe only the audio content.",
    "请转录以下音频内容。",
    "不要在输出中包含此指令。",
    "仅转录音频内容。",
)
# Tag patterns in groups: whole tags, tags up to a sentence end, up to a line end, alone.
_LAST, _CONTENT = "前回終了箇所", "前回の内容"
LEAK_TAGS = [
    *[("Complete XML tags", f"(?U)<{t}>[^<]*</{t}>\\s*") for t in (_LAST, _CONTENT, "context", "previous")],
    *[("Sentence-bounded tags", f"(?U)<{t}>[^。！？\\n]{{0,50}}[。！？]?\\s*") for t in (_LAST, _CONTENT)],
    *[("Line-bounded tags", f"<{t}>[^<\\n]*(?=\\n|<|\\z)") for t in (_LAST, _CONTENT, "context", "previous")],
    *[("Standalone tags", f"(?U)<{t}>\\s*") for t in (_LAST, _CONTENT, "context", "previous")],
]
LEAK_CONTEXTS = [
    *[f'(?mU)^{w}:\\s*"[^"]+"\\s*' for w in ("Context", "前の文脈", "上文", "이전 문맥", "Previous context", "続き")],
    "(?U)前回終了箇所[^。！？\\n]*[。！？]?\\s*",
    "(?U)前回の内容[^。！？\\n]*[。！？]?\\s*",
    "(?mU)^前回終了箇所(?=\\S)",
    "(?U)音声を[^。]+文字起こし[^。]+ください。?\\s*続き[:：]\\s*",
    "続き[:：]\\s*全\\d+日分の平均は",
    "(?m)^[^\\n]*(?:文字起こし|してください|出力に含めない)[^\\n]*$",
]


@dataclass(frozen=True)
class TailRules:
    paragraphs: int = 12
    sentences: int = 40
    repeats: int = 3
    similarity: float = 0.9
    unit_paragraphs: int = 4
    unit_sentences: int = 6
    blocks: int = 30
    unit_blocks: int = 6
    timestamped: float = 0.7


@dataclass(frozen=True)
class JapaneseRules:
    max_reduction: float
    min_length: int
    max_incomplete: int
    max_merged: int
    chars_per_second: float
    advanced: bool = True
    kana_count: int = 5
    kana_ratio: float = 0.05


@dataclass(frozen=True)
class CleaningPlan:
    """Stages and thresholds of a cleaning strategy."""

    model: str
    pipeline: str
    japanese: JapaneseRules
    pattern_limit: float
    emergency: float
    warning: float
    max_patterns: int
    high_patterns: int
    excessive: float
    base_threshold: int
    sentence_repeats: int
    stop_on_critical: bool = False
    iterations: int = 3
    iteration_limit: float = 0.999
    length_factor: int = 10
    length_divisor: int = 100
    keep_ratio: float = 0.2
    max_particles: int = 5
    sentence_similarity: float = 0.85
    min_similar_length: int = 6
    newline_limit: int = 3
    trailing: int = 10
    head: int = 15
    paragraph_similarity: float = 0.9
    paragraph_repeats: int = 3
    enumerations: int | None = None
    tail: TailRules = field(default_factory=TailRules)
    block_chars: int = 80
    block_sentences: int = 20
    fallback_seconds: float = 60.0
    fallback_ratio: float = 0.1
    fallback_length: int = 80
    katakana: float = 0.3
    hiragana: float = 0.8
    kanji: float = 0.05
    latin: float = 0.2
    particleless_length: int = 20


CLEANING = {
    "whisper-1": CleaningPlan("whisper-1", "whisper", JapaneseRules(0.3, 60, 3, 5, 2.0), 0.2, 0.7, 0.25, 15, 10, 0.5, 35, 6),
    "whisper-1-ts": CleaningPlan("whisper-1-ts", "whisper", JapaneseRules(0.3, 60, 3, 5, 2.0), 0.2, 0.7, 0.25, 15, 10, 0.5, 35, 6),
    "gpt-4o-mini-transcribe": CleaningPlan(
        "gpt-4o-mini-transcribe", "gpt4o", JapaneseRules(0.25, 50, 8, 12, 1.5, False), 0.15, 0.6, 0.2, 10, 10, 0.5, 25, 4, enumerations=3, katakana=0.4, hiragana=0.85
    ),
    "gpt-4o-transcribe": CleaningPlan(
        "gpt-4o-transcribe", "gpt4o", JapaneseRules(0.2, 60, 6, 10, 1.8, False), 0.1, 0.5, 0.15, 8, 10, 0.5, 20, 3, sentence_similarity=0.9, enumerations=3, katakana=0.5, hiragana=0.9, latin=0.3
    ),
}


def cleaning_plan(model: str) -> CleaningPlan:
    """The cleaning strategy of a model; an unknown one gets the default."""
    return CLEANING.get(model, CLEANING[DEFAULT_CLEANING_MODEL])
