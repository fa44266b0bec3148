"""Word lists, priorities and source facts that results depend on. All can be passed as parameters."""

# Stop words of the validation report (fixed values).
VALIDATION_STOP_WORDS = (
    "a o as os um uma uns umas de da do das dos em na no e ou mas que se com por para ao aos sua seu suas seus "
    "é são foi ser ter há mais não ele ela eles elas eu você nós como quando onde muito também já"
).split()

# Stop words of the quality signals (fixed values).
SIGNAL_STOP_WORDS = (
    "o a os as um uma uns umas de do da dos das no na nos nas ao aos à às pelo pela pelos pelas "
    "em com por para que se não mais como mas foi ele ela seu sua ou quando muito também já eu é são "
    "este esta isso aquele aquela neste nessa"
).split()

# Markers of the two written variants of Portuguese (fixed values).
BRAZILIAN_MARKERS = ["você", "vocês", "ônibus", "banheiro", "celular", "sorvete", "trem", "metrô", "tchau", "legal", "bacana", "moleque", "saudade", "capivara", "feira", "bagunça", "grana", "cara"]
EUROPEAN_MARKERS = ["tu", "vós", "autocarro", "casa de banho", "telemóvel", "gelado", "comboio", "metro", "adeus", "fixe", "bestial", "gajo", "miúdo", "puto", "bué", "tasca", "talho"]

# Sources from the most to the least trusted (fixed values).
SOURCE_PRIORITY = ["gigaverbo", "wikipedia_ptbr", "ulysses", "fineweb2", "madlad400", "hplt2", "common_crawl"]

# Licence and domain of each source (fixed values).
SOURCE_FACTS = {
    "gigaverbo": ("Apache 2.0", "geral/web"),
    "madlad400": ("Apache 2.0", "geral/web"),
    "fineweb2": ("ODC-By 1.0", "geral/web"),
    "hplt2": ("CC0", "geral/web"),
    "wikipedia_ptbr": ("CC BY-SA 4.0", "enciclopédico"),
    "ulysses": ("Domínio público", "jurídico/legislativo"),
    "common_crawl": ("Domínio público", "geral/web"),
}

# Small stop lists for the four languages of the test tables.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as be was are".split(),
    "fr": "le la les de des et en un une du que est pour dans par".split(),
    "de": "der die das und zu in den von ist mit des auf ein eine dem".split(),
    "es": "el la los de y en que un una del por con las se es".split(),
}
