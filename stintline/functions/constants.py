"""Names, aliases and patterns that results depend on."""

#: Circuits.
CIRCUITS = [
    "70th Anniversary", "Abu Dhabi", "Australia", "Austria", "Azerbaijan", "Bahrain", "Belgium", "Canada", "China", "Eifel", "Emilia Romagna",
    "France", "Great Britain", "Hungary", "Italy", "Japan", "Las Vegas", "Mexico City", "Miami", "Monaco", "Netherlands", "Portugal", "Qatar",
    "Russia", "Sakhir", "Saudi Arabia", "Singapore", "Spain", "Sao Paulo", "Styria", "Turkey", "Tuscany", "United States",
]
#: drivers' codes, and the surnames that stand for them.
DRIVERS = [
    "ALB", "ALO", "ANT", "BEA", "BOT", "COL", "DEV", "DOO", "GAS", "GIO", "GRO", "HAD", "HAM", "HUL", "KVY", "LAT",
    "LAW", "LEC", "MAG", "MAZ", "MSC", "NOR", "OCO", "PER", "PIA", "RAI", "RIC", "RUS", "SAI", "SAR", "STR", "TSU",
    "VER", "VET", "ZHO", "AIT", "FIT", "KUB",
]
SURNAMES = {
    "verstappen": "VER", "hamilton": "HAM", "leclerc": "LEC", "norris": "NOR", "sainz": "SAI", "russell": "RUS", "piastri": "PIA", "alonso": "ALO",
    "stroll": "STR", "gasly": "GAS", "ocon": "OCO", "perez": "PER", "tsunoda": "TSU", "ricciardo": "RIC", "albon": "ALB", "bottas": "BOT", "zhou": "ZHO",
    "magnussen": "MAG", "hulkenberg": "HUL", "sargeant": "SAR", "lawson": "LAW", "bearman": "BEA", "antonelli": "ANT", "schumacher": "MSC", "vettel": "VET",
    "raikkonen": "RAI", "latifi": "LAT", "de vries": "DEV", "doohan": "DOO", "hadjar": "HAD", "colapinto": "COL",
}
#: Circuits whose examples are for testing and for validation.
TEST_CIRCUITS, VALIDATION_CIRCUITS = ["Italy", "Monaco", "Bahrain"], ["Belgium", "Singapore", "Hungary"]

#: Aliases in questions, beside the circuits' names and their words of four letters or more.
QUESTION_ALIASES = {
    "spa": "Belgium", "monza": "Italy", "silverstone": "Great Britain", "suzuka": "Japan", "baku": "Azerbaijan", "jeddah": "Saudi Arabia",
    "interlagos": "Sao Paulo", "albert park": "Australia", "hungaroring": "Hungary", "zandvoort": "Netherlands", "barcelona": "Spain",
    "montreal": "Canada", "cota": "United States", "austin": "United States", "marina bay": "Singapore", "yas marina": "Abu Dhabi", "miami": "Miami",
    "vegas": "Las Vegas", "las vegas": "Las Vegas", "imola": "Emilia Romagna", "monte carlo": "Monaco", "red bull ring": "Austria",
    "paul ricard": "France", "portimao": "Portugal", "mugello": "Tuscany", "nurburgring": "Eifel", "losail": "Qatar", "sochi": "Russia",
}
#: Aliases in corpus texts, looked for after the circuits' names.
CORPUS_ALIASES = {
    "monza": "Italy", "italian": "Italy", "spa": "Belgium", "belgian": "Belgium", "silverstone": "Great Britain", "british": "Great Britain",
    "hungaroring": "Hungary", "hungarian": "Hungary", "marina bay": "Singapore", "baku": "Azerbaijan", "jeddah": "Saudi Arabia",
    "interlagos": "Sao Paulo", "são paulo": "Sao Paulo", "sao paulo": "Sao Paulo", "brazil": "Sao Paulo", "brazilian": "Sao Paulo",
    "imola": "Emilia Romagna", "suzuka": "Japan", "japanese": "Japan", "zandvoort": "Netherlands", "dutch": "Netherlands", "albert park": "Australia",
    "australian": "Australia", "red bull ring": "Austria", "austrian": "Austria", "paul ricard": "France", "french": "France", "yas marina": "Abu Dhabi",
    "losail": "Qatar", "cota": "United States", "istanbul": "Turkey", "mugello": "Tuscany", "nurburgring": "Eifel", "portimao": "Portugal",
    "algarve": "Portugal", "sochi": "Russia", "barcelona": "Spain", "spanish": "Spain", "las vegas": "Las Vegas", "mexico city": "Mexico City",
    "miami": "Miami", "monaco": "Monaco", "bahrain": "Bahrain", "sakhir": "Sakhir", "qatar": "Qatar", "china": "China", "shanghai": "China",
    "canada": "Canada", "montreal": "Canada",
}
#: Circuit names as sessions store them; others are stored as they are.
STORED_NAMES = {
    "Great Britain": "British", "Belgium": "Belgian", "Italy": "Italian", "Australia": "Australian", "Austria": "Austrian", "Japan": "Japanese",
    "Hungary": "Hungarian", "Netherlands": "Dutch", "Spain": "Spanish", "France": "French", "Canada": "Canadian", "Saudi Arabia": "Saudi Arabian",
    "Sao Paulo": "São Paulo", "China": "Chinese",
}


def question_aliases() -> list[tuple[str, str]]:
    """(alias, circuit), longest first; among equals, in the order in which they were named."""
    out: dict[str, str] = {}
    for c in CIRCUITS:
        out[c.lower()] = c
        out.update({w: c for w in c.lower().split() if len(w) > 3})
    out.update(QUESTION_ALIASES)
    return sorted(out.items(), key=lambda x: -len(x[0]))


def corpus_aliases() -> list[tuple[str, str]]:
    """Circuit names, longest first, then aliases, longest first."""
    names = [(c.lower(), c) for c in sorted(CIRCUITS, key=len, reverse=True)]
    return names + sorted(CORPUS_ALIASES.items(), key=lambda x: -len(x[0]))


#: Patterns of questions; all ignore case. Lists hold alternatives.
STRATEGY_CASES = [
    r"undercut",
    r"overcut",
    r"stay out",
    r"stay in",
    r"cover the",
    r"safety car",
    r"VSC",
    r"virtual safety",
    r"track position",
    r"car behind",
    r"seconds back",
    r" pit window",
    r"pitted",
    r"pitting",
    r"one-?stop",
    r"two-?stop",
    r"stint",
    r"degrad",
    r"tyre life",
    r"hards?",
    r"mediums?",
    r"softers?",
    r"graining",
    r"cliff",
    r"do we",
    r"should we",
    r" pit or",
    r"or pit\b",
    r"grid slot",
]
STRATEGY = r"\b(" + "|".join(STRATEGY_CASES) + r")\b"
DATA_ASKED_CASES = [
    r"\btelemetry\b",
    r"from (the |our )?database",
    r"from fastf1",
    r"\bqualifying (lap|pace)\b",
    r"fastest lap",
    r"show me (the )?(data|lap|time|sector)",
    r"what (was|were|is) the .{0,50}(lap|time|sector)",
    r"how fast (was|is)",
    r"\blap time\b",
    r"mini.?sector",
    r"speed trap",
    r"\bcompare\s+.+\b(to|vs|versus)\b",
]
DATA_ASKED = r"(" + "|".join(DATA_ASKED_CASES) + r")"
LAP_DATA = r"\b(?:lap\s*\d+|\d+(?:st|nd|rd|th)?\s*lap)\b|\b(compare|vs|versus)\b|\bsector\s*[123]\b|\b(Q1|Q2|Q3|FP1|FP2|FP3)\b|\b(fastest lap|telemetry|speed trap|mini.?sector)\b"
PUSHBACK_CASES = [
    r"\byou\s*are\s*wrong\b",
    r"\bi\s*don['’]t\s*think\s*so\b",
    r"\bthat'?s?\s*incorrect\b",
    r"\bcheck\s*again\b",
    r"\bverify\s*that\b",
    r"\bare\s*you\s*sure\b",
    r"\bdouble\s*check\b",
    r"\bthat\s*doesn['’]?t\s*sound\s*right\b",
    r"\bcheck\s*from\s*telemetry\b",
    r"\bgive\s*me\s*the\s*actual\s*data\b",
    r"\bnot\s*right\b",
    r"\bwrong\b.*\b(previous|last|answer)\b",
]
PUSHBACK = "|".join(PUSHBACK_CASES)
QUALIFYING, PRACTICE = r"\b(quali(?:fying)?|Q1|Q2|Q3|pole|quali\s*lap|qualifying\s*pace|grid)\b", r"\b(FP1|FP2|FP3|free\s*practice|practice)\b"
RACING = r"\b(sprint|grand\s*prix|gp\b|race\s*pace|in\s*the\s*race|stint|race lap)\b|\brace\b"
LAP_NUMBER, FASTEST, YEAR, AVERAGE = r"\b(?:lap\s*(\d+)|(\d+)(?:st|nd|rd|th)?\s*lap)\b", r"\bfastest\s*lap\b", r"\b(20[12]\d)\b", r"\b(average|mean)\s*(race\s*)?pace\b"
TOPICS = {
    "strategy": r"\b(strategy|undercut|overcut|pit stop|stint)\b",
    "tyres": r"\b(tyre|tire|compound|soft|medium|hard|intermediate|wet|deg)\b",
    "pace": r"\b(pace|lap time|race pace|quali pace)\b",
    "sectors": r"\b(sector|s1|s2|s3)\b",
    "speed": r"\b(speed|speed trap|top speed|straight.?line)\b",
    "corners": r"\b(corner|turn|apex|braking|throttle)\b",
    "weather": r"\b(rain|wet|dry|weather|conditions)\b",
    "fuel": r"\b(fuel|fuel effect|weight)\b",
    "driver": r"\b(driver|driving|style|characteristics)\b",
}
#: Patterns of answers.
NUMBER, ORDINAL, YEARS = r"-?\b\d{1,2}:\d{2}\.\d+\b|-?\d+(?:\.\d+)?", r"\b(\d+)(?:st|nd|rd|th)\b", (2018, 2027)
CLAIM = r"(\d+:\d{2}\.\d+)|(\d+\.?\d*)\s*(s|sec|/lap|s/lap|s\s*per|km/h|kph|kmh|%)|(\b\d{1,2}\.?\d*)\s*laps?\b"
#: What stands in for a claim that was struck out.
REDACTED = "[prior numeric claim redacted: verify with fresh data]"
DEGRADATION = r"(?:deg(?:radation)?(?: rate)?|degraded at|deg_rate)[^-\d]{0,40}(-?\d+(?:\.\d+)?)\s*(?:s|seconds)?\s*/?\s*lap"
VIABLE = r"(?:max(?:imum)? viable(?: tyre)? stint(?: length)?|max viable tyre stint|max_viable_laps|max stint|viable stint length)[^.\d]{0,50}(?:around|of|~|up to)?[^.\d]{0,20}(\d+)\s*laps?"
#: Misleading comparisons of sectors, and how they are reworded.
_NAME, _TIME = r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?", r"(\d+(?:\.\d+)?)"
SECTOR_WORDING = [
    (rf"\b({_NAME})\s+is\s+{_TIME}\s*s(?:econds)?\s+ahead of\s+({_NAME})\s+in\s+Sector\s+([123])\b", "$3 is $2s behind $1 in Sector $4"),
    (rf"\b({_NAME})\s+is\s+{_TIME}\s*s(?:econds)?\s+faster than\s+({_NAME})\s+in\s+Sector\s+([123])\b", "$1 has $2s advantage over $3 in Sector $4"),
    (rf"\b({_NAME})\s+has\s+{_TIME}\s*s(?:econds)?\s+deficit to\s+({_NAME})\s+in\s+Sector\s+([123])\b", "$1 is $2s behind $3 in Sector $4"),
]
#: Patterns of the facts that lead an answer.
ANCHOR_STRATEGY = r"(strategy|pit window|undercut|overcut|stretch|stint|stay out|box|compound works best|offset)"
ANCHOR_CORNER = r"(corner|corners|turn|slow-speed|medium-speed|high-speed|corner type|profile)"
ANCHOR_DEG, ANCHOR_CLIFF = r"(\d+(?:\.\d+)?)s/lap", r"cliff(?: lap)?(?: at| is| around)?(?: lap)?\s*(\d+)"
ANCHOR_VIABLE = r"(?:max(?:imum)? viable(?: stint| life)?|viable stint length(?: of)?|up to)\s*(\d+)\s+laps?"
ANCHOR_SPEED = r"(\d+(?:\.\d+)?)\s*km/h"
ANCHOR_COUNT = r"(\d+)\s+(slow|medium|high)(?:-speed)?\s+corners?"
ANCHOR_MIN = r"averages?\s+(\d+(?:\.\d+)?)\s*km/h\s+minimum speed"
ANCHOR_DELTA = r"(\d+(?:\.\d+)?)\s*km/h\s+(above|below)\s+the field"
KEY_FACTS = "Key facts: "

#: drivers' full names, and the codes that head-to-head and stay-out questions spell out.
FULL_NAMES = {
    "ALB": "Alexander Albon", "ALO": "Fernando Alonso", "ANT": "Kimi Antonelli", "BEA": "Oliver Bearman", "BOT": "Valtteri Bottas", "COL": "Franco Colapinto",
    "DEV": "Nyck de Vries", "DOO": "Jack Doohan", "GAS": "Pierre Gasly", "GIO": "Antonio Giovinazzi", "GRO": "Romain Grosjean", "HAD": "Isack Hadjar",
    "HAM": "Lewis Hamilton", "HUL": "Nico Hulkenberg", "KVY": "Daniil Kvyat", "LAT": "Nicholas Latifi", "LAW": "Liam Lawson", "LEC": "Charles Leclerc",
    "MAG": "Kevin Magnussen", "MAZ": "Nikita Mazepin", "MSC": "Mick Schumacher", "NOR": "Lando Norris", "OCO": "Esteban Ocon", "PER": "Sergio Perez",
    "PIA": "Oscar Piastri", "RAI": "Kimi Raikkonen", "RIC": "Daniel Ricciardo", "RUS": "George Russell", "SAI": "Carlos Sainz", "SAR": "Logan Sargeant",
    "STR": "Lance Stroll", "TSU": "Yuki Tsunoda", "VER": "Max Verstappen", "VET": "Sebastian Vettel", "ZHO": "Guanyu Zhou",
}
PAIR_CODES = "ALB ALO ANT BOT GAS HAM HUL LAW LEC MAG NOR OCO PER PIA RIC RUS SAI STR TSU VER VET ZHO MSC".split()
STAY_OUT_CODES = "ALB ALO BOT GAS HAM HUL LAW LEC MAG NOR OCO PER PIA RIC RUS SAI STR TSU VER VET ZHO MSC LAT".split()
#: Circuits that stay-out examples leave out, as they are held out of training.
HELD_OUT = ["Bahrain", "Bahraini", "Monaco", "Monegasque", "Belgium", "Belgian", "Hungary", "Hungarian", "Italy", "Italian", "Singapore"]

#: A time in a table's line, and the bounds of a line's first four times, in seconds.
TIME_CELL = r"(?:\d+:\d{2}\.\d+|\b\d{2,3}\.\d{2,3}\b)"
CELL_BOUNDS = [("lap_time", 60.0, 145.0), ("sector1", 10.0, 60.0), ("sector2", 10.0, 60.0), ("sector3", 10.0, 60.0)]
#: Values that a text labels, and their bounds.
LABELLED = [
    ("sector_delta", r"(?:sector\s*delta|delta).{0,6}(-?\d+\.?\d*)\s*s", -2.0, 8.0),
    ("top_speed_kmh", r"(?:top\s*speed|speed\s*trap).{0,30}(\d{3})\s*km", 270.0, 380.0),
    ("corner_min_kmh", r"(?:min(?:imum)?\s*speed|corner).{0,25}(\d{2,3})\s*km", 40.0, 330.0),
    ("tyre_deg_s_per_lap", r"(?:deg|degradation).{0,12}(\d+\.\d+).{0,8}(?:/|\s)lap", 0.001, 0.300),
    ("max_viable_laps", r"max.{0,10}viable.{0,8}(\d{1,2})\s*laps", 5.0, 55.0),
    ("cliff_lap", r"cliff.{0,6}lap.{0,5}(\d{1,2})", 3.0, 45.0),
    ("quali_race_delta", r"quali.{0,12}race.{0,12}(\d+\.?\d*)\s*s", 0.5, 20.0),
    ("driver_top_speed_rank", r"(?:rank|position).{0,4}(?:#|no\.?)\s*(\d{1,2})\b", 1.0, 25.0),
]

#: Patterns of what a dialogue names.
SPOKEN = {
    "lap_number": r"\blap\s+(\d+)\b",
    "tyre_age": r"(\d+)\s+laps?(?:\s+old|\s+on the tyres|\s+into the stint)",
    "compound": r"\b(soft|medium|hard|intermediate|wet)\b",
    "deg_rate": r"(?:degradation(?: rate)?|degradation's|deg rate(?:'s)?)\D+(\d+(?:\.\d+)?)",
    "cliff_lap": r"(?:cliff(?: lap)?(?: is| at|, number)?|tyre cliff(?: lap)?(?: is| at)?)\D+(\d+)",
    "max_viable_laps": r"max viable(?: tyre)? stint(?: is| of)?\D+(\d+)",
}
#: A lap or sector time in a reply, and words that call a driver slower.
STATED_TIME = r"\b\d+:\d{2}\.\d{3}\b|\b\d{2,3}\.\d{3}\b"
SLOWER = r"\b(struggling|deficit|slower|behind|losing time|losing out)\b"
