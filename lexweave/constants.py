"""Fixed values of the retrieval, extraction and conversion rules, and the parameters built on them."""

from __future__ import annotations

from dataclasses import dataclass

# -- fixed values: parameters ------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Every number that a rule uses; defaults are the values in force."""

    top_k_base: int = 20
    graph_seed: int = 15
    graph_limit: int = 8
    graph_decay: float = 0.75
    repeat_share: float = 0.5  #: what a second and later keyword adds of its score
    definition_keywords: int = 3
    definition_top_k: int = 5
    definition_candidates: int = 20
    context_chars: int = 20_000
    confidence_threshold: float = 0.45
    history_turns: int = 6
    history_answer_chars: int = 250
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    local_weight: float = 0.6
    global_weight: float = 0.4
    alpha: float = 0.30
    beta: float = 0.70
    term_min_chars: int = 3
    tfidf_top_n: int = 30
    keyphrase_top_n: int = 20
    keyphrase_chars: int = 2000
    keyphrase_diversity: float = 0.72
    final_n: int = 25
    cross_lingual_boost: float = 1.25
    phrase_to_word: float = 0.80
    title_repeats: int = 3
    batch_articles: int = 15
    batch_chars: int = 60_000
    batch_overhead_chars: int = 120
    keywords_per_article: int = 20
    dry_run_tokens_per_article: int = 386
    dry_run_tokens_base: int = 50
    dry_run_tokens_warn: int = 7_500
    entity_min_chars: int = 5
    entities_per_kind: int = 5
    range_length: int = 10
    embedding_chars: int = 512
    language_share: float = 0.01


SETTINGS = Settings()

# -- fixed values: names -----------------------------------------------------

#: slug, Russian name, Kazakh name
CODEXES = (
    ("admin_offenses", "Кодекс об административных правонарушениях", "Әкімшілік құқық бұзушылықтар туралы кодекс"),
    ("admin_proc", "Административный процедурно-процессуальный кодекс", "Әкімшілік рәсімдік-процестік кодекс"),
    ("budget", "Бюджетный кодекс", "Бюджет кодексі"),
    ("civil_general", "Гражданский кодекс (Общая часть)", "Азаматтық кодекс (Жалпы бөлім)"),
    ("civil_proc", "Гражданский процессуальный кодекс", "Азаматтық процестік кодекс"),
    ("civil_special", "Гражданский кодекс (Особенная часть)", "Азаматтық кодекс (Ерекше бөлім)"),
    ("construction", "Градостроительный кодекс", "Қала құрылысы кодексі"),
    ("criminal", "Уголовный кодекс", "Қылмыстық кодекс"),
    ("criminal_exec", "Уголовно-исполнительный кодекс", "Қылмыстық-атқару кодексі"),
    ("criminal_proc", "Уголовно-процессуальный кодекс", "Қылмыстық-процестік кодекс"),
    ("customs", "Кодекс о таможенном регулировании", "Кедендік реттеу туралы кодекс"),
    ("digital", "Цифровой кодекс", "Цифрлық кодекс"),
    ("entrepreneurial", "Предпринимательский кодекс", "Кәсіпкерлік кодекс"),
    ("environmental", "Экологический кодекс", "Экологиялық кодекс"),
    ("family", "Кодекс о браке (супружестве) и семье", "Неке (ерлі-зайыптылық) және отбасы туралы кодекс"),
    ("forest", "Лесной кодекс", "Орман кодексі"),
    ("health", "Кодекс о здоровье народа и системе здравоохранения", "Халық денсаулығы және денсаулық сақтау жүйесі туралы кодекс"),
    ("labor", "Трудовой кодекс", "Еңбек кодексі"),
    ("land", "Земельный кодекс", "Жер кодексі"),
    ("social", "Социальный кодекс", "Әлеуметтік кодекс"),
    ("subsoil", "Кодекс о недрах и недропользовании", "Жер қойнауы және жер қойнауын пайдалану туралы кодекс"),
    ("tax_code", "Налоговый кодекс", "Салық кодексі"),
    ("tax_payments", "Кодекс о налогах и других обязательных платежах в бюджет", "Салықтар және бюджетке төленетін басқа да міндетті төлемдер туралы кодекс"),
    ("water", "Водный кодекс", "Су кодексі"),
)

CODEX_GROUPS = {
    "is_criminal": ("criminal", "criminal_proc", "criminal_exec"),
    "is_civil": ("civil_general", "civil_special", "civil_proc"),
    "is_tax": ("tax_code", "tax_payments"),
    "is_labor": ("labor",),
    "is_admin": ("admin_offenses", "admin_proc"),
}

STORED_RELATIONS = (
    "BASED_ON", "CAUSED_BY", "CORRELATED_WITH", "EXTENDS", "MANIFESTED_IN", "REFERENCES", "CREATES_OBLIGATION", "GRANTS_RIGHT", "IMPOSES_SANCTION",
    "AMENDS", "SUPPLEMENTS", "REQUIRES", "PROHIBITS", "DEFINES",
)
EXTRACTED_RELATIONS = ("CAUSED_BY", "BASED_ON", "MANIFESTED_IN", "CORRELATED_WITH", "EXTENDS", "REFERENCES")
TRAVERSED_RELATIONS = ("CORRELATED_WITH", "REFERENCES", "EXTENDS", "MANIFESTED_IN", "BASED_ON", "CAUSED_BY")

# -- fixed values: word lists ------------------------------------------------

KAZAKH_LETTERS = "әіңғүұқөһӘІҢҒҮҰҚӨҺ"

STOPWORDS_RU = (
    "статья пункт подпункт часть раздел глава параграф закон кодекс настоящий настоящего настоящем настоящей настоящее данный указанный соответствии порядке "
    "установленном установленного предусмотренных предусмотренном республика казахстан республики казахстана который которая которые которых которому которой "
    "которым после дней лет года году также либо если должен должна должно должны является являются будет быть было были этого этом этот эта один одно одна "
    "может могут иной иное иных своих своим вводится действие действия опубликования официального принятого сноска изменениями внесенными законами законом "
    "редакции введение настоящим но или что как при до со из для его они она оно мы вы он ей им их нет более менее такой такая такие такого такому этой этому "
    "тот той том того тем тех"
).split()

STOPWORDS_KZ = (
    "бап бабы бапқа баптың баптар баптарда баптарының тармақ тармағы тармақшасы тармақтарда тармақтарының ескерту кодексі кодексінің кодексіне кодексінде "
    "республикасы қазақстан қазақстанның қазақстанда осы болып арқылы үшін және сәйкес бойынша туралы заңымен заңы заңның заңда заңдарымен енгізіледі "
    "енгізілген жылы жылдан бастап дейін ретінде болған белгіленген көзделген мен мына осыған оның олар оларға оларда олардың бұл бұған егер немесе де да кейін "
    "алдында жоқ бар болады болуы болса берілген жүргізілетін жасалатын қолданылатын"
).split()

# -- fixed values: patterns --------------------------------------------------

ENTITY_PATTERNS = {
    "subjects": (
        "физическое лицо", "юридическое лицо", "гражданин", "организация", "компания", "индивидуальный предприниматель", "государственный орган",
        "должностное лицо", "работник", "работодатель",
    ),
    "sanctions": (
        "штраф", "лишение свободы", "ограничение свободы", "исправительные работы", "запрещение деятельности", "конфискация", "арест", "дисквалификация",
        "приостановление", "возмещение убытков",
    ),
    "obligations": (
        "обязан", "должен", "обязательно", "обязательство", "обязанность", "несет ответственность", "отвечает", "ответственен", "подлежит возмещению",
        "подлежит оплате",
    ),
    "rights": (
        "имеет право", "может", "вправе", "правомочие", "допускается", "разрешается", "предусмотрено", "предоставляется право", "уполномочен", "способен",
    ),
    "prohibitions": (
        "не имеет права", "не может", "не должен", "запрещается", "запрещено", "недопустимо", "не допускается", "не признается", "исключается", "не подлежит",
    ),
    "definitions": (
        "понимается как", "означает", "определяется как", "следует понимать", "в смысле", "считается", "является", "именуется", "называется", "в целях",
    ),
}
DATE_PATTERN = r"\d{1,2}\.\d{1,2}\.\d{4}"

REFERENCE_PATTERNS = (
    r"(?:ст(?:атье?й?|атьях)?\.?\s*)(\d+(?:[–\-]\d+)?(?:\.\d+)?)",
    r"(?:статьями?\s*)(\d+(?:[–\-]\d+)?)",
)
#: All case forms, anchored at a word's beginning; a hyphenated number is a number.
STRICT_REFERENCE_PATTERNS = (r"(?<![\p{L}\p{N}])(?:ст\.|стат(?:ья|ьи|ье|ью|ьей|ьёй|ей|ьям|ьями|ьях))\s*(\d+(?:[–\-]\d+)?(?:\.\d+)?)",)

CITATION_RU = r"стать[яеию]\s+([\d]+(?:-[\d]+)*)"
CITATION_KZ = r"([\d]+(?:-[\d]+)*)-(?:бап|баптың|бабы|бабының)"
TERM = r"[а-яёА-ЯЁa-zA-ZәіңғүұқөһӘІҢҒҮҰҚӨҺ]{3,}"

#: Heading patterns of a bold line, in order of precedence, and their levels.
HEADINGS = (
    (r"кодекс", 1),
    (r"(ОБЩАЯ ЧАСТЬ|ОСОБЕННАЯ ЧАСТЬ|ЖАЛПЫ\s+БӨЛІК|ЖАЛПЫ\s+БӨЛІМ|ЕРЕКШЕ\s+БӨЛІК|ЕРЕКШЕ\s+БӨЛІМ)", 1),
    (r"^(Раздел|РАЗДЕЛ)\s+[IVXLCDM\d]", 2),
    (r"^\d[\d\-]*-БӨЛ[ІI]М", 2),
    (r"^БӨЛ[ІI]М\s+\d", 2),
    (r"^\d[\d\-]*\s*[-–]\s*БӨЛ[ІI]М", 2),
    (r"^(Глава|ГЛАВА)\s+\d", 3),
    (r"^\d[\d\-]*-тарау", 3),
    (r"^\d+(?:-\d+)?\s+тарау", 3),
    (r"^ТАРАУ\s+\d", 3),
    (r"^\d[\d\-]*-КІШІ\s+БӨЛ[ІI]М", 3),
    (r"^\d[\d\-]*-бөл[іi]мше", 3),
    (r"^\d+\s+бөл[іi]м", 3),
    (r"^[СC]татья\s+\d", 4),
    (r"^\d[\d\-]*-бап", 4),
    (r"^\d+(?:-\d+)?\s+бап", 4),
    (r"^(Параграф|ПАРАГРАФ|§)\s+\d", 4),
    (r"^\d[\d\-]*-параграф", 4),
)
LEADING_QUOTES = r"^[«\"'“”‘’]+"
LEADING_NUMBER = r"^\d+\.\s+"

#: Block kinds, the first that matches wins; an article's group 1 is its number.
ARTICLE_RU = r"^[СC]татья\s+([\d]+(?:-[\d]+)*)[\.\s]"
ARTICLE_KZ = r"^([\d]+(?:-[\d]+)*)-(?:бап|баn|бабы|баптың)[\.\s]?"
PARAGRAPH_KZ = r"^[\d][\d\-]*-параграф[\.\s]"
PARAGRAPH_RU = r"^(?:§\s*\d+|Параграф\s+\d+)"
SECTION = r"\b(?:РАЗДЕЛ|Б[ӨО]Л[І2Ii]М)\b"
CHAPTER = r"\b(?:Глава|тарау)\b"

IMAGE = r"!\[[^\]]*\]\([^)]*\)(?:\{[^}]*\})?\s*(?:\n\s*\{[^}]*\})?\s*\n?"
SPAN_ATTRIBUTES = r"\[([^\]]+)\]\{[^}]+\}"
ESCAPE = r"""\\([`*_{}\[\]()#+\-.!|"'])"""
HARD_BREAK = r"\\[ \t]*\n?"
FOOTNOTE = r"^(Сноска\.|Ескерту\.)\s+.+$"
SERVICE_NOTE = (
    r"^(?:Примечание\s+[А-ЯЁA-Za-z][А-ЯЁA-Za-z\-\.]*!|ЗҚАИ[\-\.]\s*ның\s+ескертпесі!|ЗҚАИ\s+ескертпесі!|Вниманию\s+пользователей!"
    r"|Қолданушылар\s+назарына!|Пайдаланушылар\s+назарына!)\s*$"
)
INSUFFICIENT = "НЕДОСТАТОЧНО"
MISSING_KZ = "text_kz: [NOT AVAILABLE -- translate Russian legal terms into Kazakh for the 'kz' keyword array. Do NOT return an empty list.]"
DEFINITIONS_TITLE = "\n--- ПРАВОВЫЕ ОПРЕДЕЛЕНИЯ ---"
HISTORY_TITLE = "История разговора:"
ARTICLE_LABEL = "Статья"
EMPTY_ANSWER = "Не удалось сформировать ответ на основе предоставленного контекста."
OFF_TOPIC_ANSWER = (
    "Ваш вопрос не относится к правовой сфере Республики Казахстан. Пожалуйста, задайте юридический вопрос о законодательстве РК."
)
