"""Fixed values that results depend on, stated as plain text."""

# English stop words (apostrophes kept, as in the usual published list).
BASE_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# Additions for song texts.
EXTRA_STOPWORDS = (
    "yeah oh ooh uh ah hmm mmm "
    "like got get know dont im youre hes shes its theyre ive cant wont thats "
    "gon wan na da la hey yo em ya huh"
).split()

# Words that the tokenizer splits in two.
CONTRACTIONS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]

# Noun endings and what a lemma may have in their place.
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
]

# Sentiment label -> code.
LABEL_CODES = {"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}

# Record grammar of a text collection.
RECORD_SEPARATOR = "=" * 50
HEADER_PREFIX = "LYRICS COLLECTION"
TITLE_LINE = r"--- '(.+?)' by (.+?) ---"

# Strings of the result table.
TOPICS_DEFAULT = "Preprocessing Skipped/Failed"
TOPICS_NONE = "N/A"

# The five signal features, in report order.
SIGNAL_FEATURES = [
    "tempo",
    "vocal_tone_quality",
    "sound_brightness",
    "musical_note_strength",
    "sound_loudness",
]
