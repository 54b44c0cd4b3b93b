"""Fixed values that results depend on."""

# Speakers whose text is kept but never narrated.
RETAINED_SPEAKERS = ("Retained", "Unvoiced", "Silent")

# Delivery styles, in the order in which they are tried.
EMOTIONS = (
    "neutral", "happy", "sad", "angry", "fearful", "surprised", "whispering",
    "shouting", "sarcastic", "excited", "contemplative", "tender", "stern", "pleading",
)

# Words that are never a name.
ALIAS_STOPWORDS = tuple(
    """
    i me my mine myself
    you your yours yourself yourselves
    he him his himself
    she her hers herself
    it its itself
    we us our ours ourselves
    they them their theirs themselves
    who whom whose
    someone somebody anyone anybody everyone everybody
    one ones others another
    this that these those
    """.split()
)

# The cast of a book that has none yet, as (name, description, voice).
DEFAULT_CAST = (
    ("Narrator", "The book's narrating voice.", "Warm, articulate male voice; mature age; measured slow pace; authoritative yet compassionate."),
    ("Extra Female", "An unnamed or minor female character.", "Neutral, casual, female voice, older adult; lower than average pitch."),
    ("Extra Male", "An unnamed or minor male character.", "Gruff, textured baritone voice; older adult; relaxed slow speed; weary but kind."),
)

# Tags whose text is content, tags that are dropped.
CONTENT_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th")
SKIP_TAGS = ("script", "style", "meta", "head", "link", "noscript", "nav", "header", "footer")

# Sizes and limits.
MIN_CHAPTER_WORDS = 50
MAX_CHUNK_CHARS = 500
SCRIPT_CHUNK_WORDS = 1500
CAST_CHUNK_WORDS, CAST_OVERLAP_WORDS = 4000, 400
SAMPLE_RATE = 24000
PARAGRAPH_PAUSE_MS = 500

# Thresholds of the audio checks.
SILENCE_MEAN_ABS = 0.001
CLICK_FIRST_SAMPLE = 0.05
TRUNC_LAST_SAMPLE = 0.05
CLIP_THRESHOLD, CLIP_RUN_SAMPLES = 0.99, 16
NOISY_CREST_TIGHT, NOISY_MED_TIGHT = 3.5, 0.08
NOISY_CREST_LOOSE, NOISY_MED_LOOSE, NOISY_LOOSE_MIN_DUR_S = 4.5, 0.07, 3.0

# HTTP statuses after which a request is worth another try.
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504)
