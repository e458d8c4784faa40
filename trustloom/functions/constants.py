"""Fixed values. These must stay as they are for results to agree with the published definitions."""

LABELS = ("fake", "real")

# Stop list of cleaner "a".
STOP_A = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with i you your me my"
).split()

# Stop list of cleaner "b".
STOP_B = (
    "a about above after again all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from had has have he her here him his how i if in is it its just "
    "me more most my no nor not of off on or our out over s same she so some such t than that the their them then "
    "there these they this those through to too under until up was we were what when where which while who why with "
    "you your"
).split()

# Stop list of cleaner "c": the English list of the NLTK corpus.
STOP_C = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
    "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Words that the treebank tokeniser cuts in two, as (head, tail).
CONTRACTIONS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))

# Noun endings and what they become in the base form (WordNet's detachment rules).
NOUN_ENDINGS = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"),
)

# Characters the sequence tokeniser turns into blanks.
SEQUENCE_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# Trust parameters: a vehicle decays by the hour, a news source by the day.
VEHICLE = {"unit": "hour", "rate": 0.1, "reward": 0.1, "keep": 0.5}
SOURCE = {"unit": "day", "rate": 0.05, "reward": 0.1, "keep": 0.8}
START_TRUST = 50.0

# Texts a data frame reader takes for missing values.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Replies to requests that cannot be scored.
INVALID_BODY = "Invalid request body"
TEXT_REQUIRED = "'text' field is required"

# Columns of the source event file, in order.
SOURCE_EVENT_COLUMNS = ("source_id", "title", "text", "prediction", "timestamp")

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
