"""Fixed values that must equal the reviewed application's for equal results.

Everything below is a fixed value: labels, name hints, patterns, token lists and
preset parameters. They are stated as text, in their natural order.
"""

# --- fixed values: column kind labels -------------------------------------
KIND_NUMERIC = "Sayısal/Tutar"
KIND_CATEGORICAL = "Kategorik/Metin"
KIND_DATETIME = "Tarih"
KIND_ID = "ID/Referans"
KIND_EXCLUDED = "Analiz dışı"

# --- fixed values: column-name hints (plain substrings of the lower-cased name)
NUMERIC_NAME_HINTS = (
    "amount", "amt", "tutar", "balance", "bakiye", "blnc",
    "price", "fiyat", "rate", "oran", "score", "skor", "puan",
    "count", "adet", "sayisi", "sayı", "miktar", "qty", "quantity",
    "fee", "ucret", "ücret", "tax", "vergi", "interest", "faiz",
    "cost", "maliyet", "value", "deger", "değer",
    "duration", "sure", "süre", "age", "yas", "yaş",
    "amnttl", "amntfc", "salary", "maas", "maaş",
    "revenue", "gelir", "expense", "gider",
)
DATETIME_NAME_HINTS = (
    "date", "tarih", "time", "saat", "datetime", "timestamp",
    "created", "updated", "olusturma", "oluşturma", "guncelleme",
    "guncellendi", "year", "yil", "yıl", "month", "ay",
)

# --- fixed values: regular expressions ------------------------------------
# Kind inference: ID-like column name (applied to the lower-cased name).
ID_KIND_NAME_RE = (r"(?:^|[_\-\s])id(?:[_\-\s]|$)|^id$|_id$|^id_|"
                   r"(?:^|[_\-\s])(uuid|ref|kod|code|no|number|tcno|tckn|"
                   r"iban|accno|acct|msisdn|guid|kimlik)(?:[_\-\s]|$)")
# Column selection: ID column name, case-insensitive.
ID_SELECT_NAME_RE = r"(?:^|[_\- ])id(?:[_\- ]|$)|^id$|_id$|Id$|ID$|^id_|^ID_"
# Turkish thousands/decimal number, e.g. 1.234,56
TR_NUMBER_RE = r"^-?\d{1,3}(\.\d{3})*(,\d+)?$"
CURRENCY_PREFIX_RE = r"^(₺|\$|€|£)"
CURRENCY_SUFFIX_RE = r"(TL|TRY|USD|EUR|GBP)$"
CONTROL_CHAR_RE = r"[\r\n\t\x00-\x08\x0b\x0c\x0e-\x1f]"
DIGITS_ONLY_RE = r"^\s*\d+\s*$"

# --- fixed values: rule tokens ---------------------------------------------
NAME_TOKENS = ("name", "isim", "ad", "soyad", "unvan")
CURRENCY_TOKENS = ("cur", "currency", "para", "doviz", "döviz")
BRANCH_TOKENS = ("brchn", "branch", "sube", "şube", "office", "location")
COUNTRY_TOKENS = (
    "İNGİLTERE", "AMERİKA", "ALMANYA", "FRANSA", "İTALYA", "İSPANYA",
    "ABD", "ENGLAND", "USA", "GERMANY", "FRANCE", "ITALY",
    "TURKİYE", "CHINA", "ÇİN", "RUSSIA", "RUSYA",
)
DUPLICATE_ID_EXACT_NAMES = ("proc", "id", "ref")

# --- fixed values: data-quality rule keys and severities --------------------
RULE_REQUIRED = "boş_zorunlu_alan"
RULE_NEGATIVE = "negatif_tutar"
RULE_ZERO = "sıfır_tutar"
RULE_EXTREME = "aşırı_uç_değer"
RULE_BAD_NUMBER = "parse_edilemeyen_sayı"
RULE_BAD_DATE = "parse_edilemeyen_tarih"
RULE_FUTURE_DATE = "uzak_gelecek_tarih"
RULE_PAST_DATE = "uzak_geçmiş_tarih"
RULE_CONTROL_CHAR = "kontrol_karakteri"
RULE_LONG_TEXT = "aşırı_uzun_metin"
RULE_DIGITS_IN_NAME = "isim_alanında_sadece_rakam"
RULE_CURRENCY = "beklenmeyen_para_birimi"
RULE_DUPLICATE_ID = "tekrarlayan_id"

RULE_SEVERITY = {
    RULE_REQUIRED: "high",
    RULE_NEGATIVE: "medium",
    RULE_ZERO: "low",
    RULE_EXTREME: "medium",
    RULE_BAD_NUMBER: "high",
    RULE_BAD_DATE: "high",
    RULE_FUTURE_DATE: "medium",
    RULE_PAST_DATE: "medium",
    RULE_CONTROL_CHAR: "high",
    RULE_LONG_TEXT: "low",
    RULE_DIGITS_IN_NAME: "high",
    RULE_CURRENCY: "medium",
    RULE_DUPLICATE_ID: "high",
}
SEVERITY_LABEL = {"high": "Yüksek", "medium": "Orta", "low": "Düşük"}
SEVERITY_DEFAULT_LABEL = "Bilgi"

# --- fixed values: thresholds ------------------------------------------------
EXTREME_Z = 4.0
FUTURE_DAYS = 3650
PAST_LIMIT = "1900-01-01"
LONG_TEXT_THRESHOLD = 200
NUMERIC_CONTENT_SHARE = 0.85
NUMERIC_CONTENT_SAMPLE = 500
DATETIME_CONTENT_SHARE = 0.8
DATETIME_CONTENT_SAMPLE = 200
TYPE_SPLIT_SAMPLE = 50
SILHOUETTE_SAMPLE = 5000
FREE_TEXT_SAMPLE = 200
ID_RATIO_KIND = 0.95
ID_RATIO_NUMERIC = 0.95
ID_RATIO_OTHER = 0.9
MAX_SELECTED_COLUMNS = 30
MAX_MEDIUM_CARD = 6
LOW_CARD_LIMIT = 30
MEDIUM_CARD_LIMIT = 200
RARE_FEATURE_THRESHOLD = 0.005
FEEDBACK_FLAG_THRESHOLD = 0.7
BAND_K = 2.5
ROLLING_MIN_PERIODS = 3

# --- fixed values: model keys in tie-break order -----------------------------
MODEL_KEYS = ("isolation_forest", "lof", "ocsvm")

# --- fixed values: presets ---------------------------------------------------
# toggles: rule -> on/off; rules not listed are on.
PRESETS = {
    "Genel (Varsayılan)": {
        "contamination_default": 0.05,
        "contamination_range": (0.01, 0.30),
        "model_weights": {"isolation_forest": 1.0, "lof": 1.0, "ocsvm": 1.0},
        "numeric_hints": (),
        "rule_checks": {
            "isim_alanında_sadece_rakam": True,
            "kontrol_karakteri": True,
            "negatif_tutar": False,
            "sıfır_tutar": False,
            "aşırı_uç_değer": True,
            "tekrarlayan_id": True,
            "beklenmeyen_para_birimi": False,
        },
        "allowed_currencies": [],
        "encoding": {"onehot_max_unique": 15, "rare_threshold": 0.005},
    },
    "İşlem / Finans Verisi": {
        "contamination_default": 0.02,
        "contamination_range": (0.005, 0.15),
        "model_weights": {"isolation_forest": 1.1, "lof": 1.3, "ocsvm": 1.0},
        "numeric_hints": ("amnttl", "amntfc", "blnc", "tutar", "bakiye", "fee", "ucret"),
        "rule_checks": {
            "isim_alanında_sadece_rakam": True,
            "kontrol_karakteri": True,
            "negatif_tutar": True,
            "sıfır_tutar": True,
            "aşırı_uç_değer": True,
            "tekrarlayan_id": True,
            "beklenmeyen_para_birimi": True,
        },
        "allowed_currencies": ["TRY", "USD", "EUR", "GBP", "CHF", "JPY", "CAD", "AUD",
                               "AED", "RUB", "CNY", "XAU", "XAG"],
        "encoding": {"onehot_max_unique": 20, "rare_threshold": 0.003},
    },
    "İnsan Kaynakları Verisi": {
        "contamination_default": 0.05,
        "contamination_range": (0.02, 0.20),
        "model_weights": {"isolation_forest": 1.0, "lof": 1.2, "ocsvm": 0.9},
        "numeric_hints": ("salary", "maas", "maaş", "yas", "yaş", "deneyim",
                          "performance", "performans", "puan", "skor"),
        "rule_checks": {
            "isim_alanında_sadece_rakam": True,
            "kontrol_karakteri": True,
            "negatif_tutar": True,
            "sıfır_tutar": False,
            "aşırı_uç_değer": True,
            "tekrarlayan_id": True,
            "beklenmeyen_para_birimi": False,
        },
        "allowed_currencies": [],
        "encoding": {"onehot_max_unique": 25, "rare_threshold": 0.01},
    },
    "Çağrı Merkezi Verisi": {
        "contamination_default": 0.05,
        "contamination_range": (0.02, 0.20),
        "model_weights": {"isolation_forest": 1.1, "lof": 1.0, "ocsvm": 1.0},
        "numeric_hints": ("duration", "sure", "süre", "wait", "bekleme",
                          "satisfaction", "memnuniyet", "puan", "skor", "count"),
        "rule_checks": {
            "isim_alanında_sadece_rakam": False,
            "kontrol_karakteri": True,
            "negatif_tutar": True,
            "sıfır_tutar": True,
            "aşırı_uç_değer": True,
            "tekrarlayan_id": False,
            "beklenmeyen_para_birimi": False,
        },
        "allowed_currencies": [],
        "encoding": {"onehot_max_unique": 20, "rare_threshold": 0.01},
    },
    "Operasyon / Üretim Verisi": {
        "contamination_default": 0.04,
        "contamination_range": (0.01, 0.20),
        "model_weights": {"isolation_forest": 1.2, "lof": 1.0, "ocsvm": 1.0},
        "numeric_hints": ("temp", "sicaklik", "sıcaklık", "pressure", "basinc", "basınç",
                          "speed", "hiz", "hız", "rpm", "qty", "adet",
                          "weight", "agirlik", "ağırlık"),
        "rule_checks": {
            "isim_alanında_sadece_rakam": False,
            "kontrol_karakteri": True,
            "negatif_tutar": True,
            "sıfır_tutar": True,
            "aşırı_uç_değer": True,
            "tekrarlayan_id": False,
            "beklenmeyen_para_birimi": False,
        },
        "allowed_currencies": [],
        "encoding": {"onehot_max_unique": 20, "rare_threshold": 0.005},
    },
}
DEFAULT_PRESET = "Genel (Varsayılan)"

# --- fixed values: display texts -----------------------------------------------
RULE_DESCRIPTIONS = {
    RULE_REQUIRED: "Bu kolonda zorunlu olduğu halde değer eksik",
    RULE_NEGATIVE: "Sayısal alanda negatif değer (tutar/bakiye için sıra dışı)",
    RULE_ZERO: "Tutar tam sıfır",
    RULE_EXTREME: "Standart sapmanın 4 katından fazla sapma",
    RULE_BAD_NUMBER: "Sayısal olması beklenen alanda parse edilemeyen değer",
    RULE_BAD_DATE: "Tarih olması beklenen alanda parse edilemeyen değer",
    RULE_FUTURE_DATE: "10 yıldan uzak gelecek tarih",
    RULE_PAST_DATE: "1900 öncesi tarih",
    RULE_CONTROL_CHAR: "Metinde \\n, \\t, \\r gibi kontrol karakterleri",
    RULE_LONG_TEXT: "{threshold} karakterden uzun değer",
    RULE_DIGITS_IN_NAME: "İsim alanında sadece rakam — bozuk veya kasıtlı manipülasyon olabilir",
    RULE_CURRENCY: "{allowed} dışında para birimi",
    RULE_DUPLICATE_ID: "Aynı ID/Referans birden fazla kez görülüyor",
}
QUALITY_FLAG_REASONS = {
    "constant": "Tek bir değer içeriyor, analiz için bilgi taşımaz",
    "id_like": "Her satırda neredeyse farklı bir değer var — muhtemelen ID sütunu",
    "free_text": "Serbest metin alanı — anomali tespitine uygun değil",
    "high_cardinality": "Çok fazla kategori var, otomatik olarak frekans bazlı dönüşüm uygulanacak",
}
SELECTION_REASONS = {
    "id": "ID/Referans olarak işaretlendi",
    "constant": "Tek değer içeriyor (bilgi taşımaz)",
    "id_like": "ID benzeri (her satırda neredeyse farklı)",
    "free_text": "Serbest metin alanı",
    "numeric": "Sayısal alan",
    "datetime": "Tarih alanı (zaman serisi panelinde kullanılır)",
    "low_card": "Düşük kardinaliteli kategorik",
    "mid_card_in": "Orta kardinaliteli kategorik (frekans-encode)",
    "mid_card_out": "Orta kardinaliteli — kapsam dengesi için dışarıda",
    "high_card": "Yüksek kardinaliteli ({n} kategori) — modele eklenmedi",
    "limit": "Default kapsam üst sınırı ({max_columns}) doldu",
}
# explanation texts (Java format patterns for format_string)
REASON_NUMERIC = "**%s** değeri **%.2f** — tipik **%.2f**'den %.1fσ daha %s"
REASON_RARE = "**%s** = `%s` veri setinde **%%%.2f** sıklıkta — nadir görülen bir değer"
REASON_UNSEEN = "**%s** = `%s` — veri setinde başka örneği yok"
REASON_COMBO = "Kombinasyon (%s) veri setinde **%%%.2f** sıklıkta — olağan dışı"
REASON_RULE = "Kural ihlali: **{rule}**"
DIRECTION_HIGH = "yüksek"
DIRECTION_LOW = "düşük"
