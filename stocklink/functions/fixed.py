"""Values that the domain fixes: letters, units, words, sizes, grades, weights and thresholds.

FIXED VALUES.  Nothing here is a choice of ours; results depend on each entry
as it stands.  What is done with them is in the other modules.
"""

from __future__ import annotations

# Latin letters and the Cyrillic ones that look like them, by place.
LATIN_LOOKALIKES = "AaBCcEeHKkMOoPpTXxYyVvNuUiIsShmt"
CYRILLIC_LOOKALIKES = "АаВСсЕеНКкМОоРрТХхУуВвНиИіІѕЅнмт"

# Cyrillic letters in Latin spelling.
CYRILLIC_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "і": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ї": "i", "є": "e", "ґ": "g", "ѕ": "s",
}

# Cyrillic letters of codes and the Latin ones they are read as, by place.
CODE_CYRILLIC = "авсенікморѕтух"
CODE_LATIN = "abcehikmopstyx"

# Units of request lines and their one spelling.
UNITS = {
    "шт": "шт", "шт.": "шт", "pcs": "шт", "компл": "компл", "компл.": "компл", "комплект": "компл", "комп.": "компл", "м": "м", "мп": "м", "м.п.": "м", "м2": "м2", "м3": "м3", "кг": "кг", "л": "л", "уп": "уп", "уп.": "уп", "упак": "уп", "упак.": "уп", "пара": "пара",
}
# Units as they may stand in a cell of their own.
UNIT_CELLS = ("шт", "шт.", "м", "м2", "м3", "кг", "л", "компл", "компл.", "комп", "уп", "уп.", "пара")
# Units that search text leaves out.
UNIT_TOKENS = ("мм", "мм.", "mm", "mm.", "шт", "шт.", "м", "м.", "кг", "кг.")

# Words of request lines.
COMMENT_WORDS = ("срочно", "аналог", "замена", "доставка", "обязательно", "желательно")
GREETINGS = ("добрый", "здравствуйте", "нужны", "нужен", "интересует", "прошу", "спасибо", "добрый день")
REQUEST_PREFIXES = ("нужно ", "нужна ", "нужен ", "нужны ", "надо ", "прошу ", "пожалуйста ")
# Parts of words by which a line of headers is known.
HEADER_PARTS = {
    "name": ("наимен", "материал", "товар", "номенклат", "продукц", "описан", "характер"), "quantity": ("колич", "кол-во", "кол во", "qty", "колво", "всего кол"), "position": ("позиц", "номер", "№"),
    "unit": ("ед. изм", "ед изм", "единиц", "измер"), "vendor": ("производ", "бренд", "постав", "изготов"),
}
# Parts of Latin words by which a header cell names a role.
HEADER_WORDS = {
    "position": ("poz", "nomer"), "name": ("naim", "harakter", "tovar", "nomenklat", "opisan", "produk"), "mark": ("tip", "mark", "obozn", "art"), "supplier_code": ("kod", "artikul"), "vendor": ("zavod", "izgotov", "postav", "brand"),
    "unit": ("edinic", "izmer", "edizm", "ed izm"), "quantity": ("kolich", "kolvo", "kol-vo", "kvo", "k-vo", "qty"),
}
# Confidence of a quantity by where it was found, of a line without one, and of table lines.
QUANTITY_CONFIDENCE = {"named": 0.95, "after_unit": 0.93, "before_unit": 0.92, "times": 0.84, "leading": 0.80, "none": 0.45, "delimited": 0.98, "sheet": 0.99}

# Tokens that say nothing about an item.
COMMON_TOKENS = ("sht", "sht.", "komplekt", "komplektom", "trub", "sistema", "sistem", "detal", "material", "izdelie", "oborudovanie", "postavka", "zakazchika", "шт", "шт.")
GENERIC_TOKENS = (*COMMON_TOKENS, "gost", "truba", "detal", "material", "izdelie", "zakazchika", "kakoi", "kakaya", "kakoe", "kakoi-to")

# Inch sizes and nominal diameters; nominal and outer diameters of water and gas pipes.
INCH_TO_DN = {"1/2": "15", "3/4": "20", "1": "25", "11/4": "32", "1-1/4": "32", "11/2": "40", "1-1/2": "40", "2": "50", "21/2": "65", "2-1/2": "65", "3": "80", "4": "100"}
VGP_OD = {"15": "21.3", "20": "26.8", "25": "33.5", "32": "42.3", "40": "48", "50": "60", "65": "75.5", "80": "88.5", "100": "114"}
ANGLES = ("15", "30", "45", "60", "87", "87.5", "90", "120", "180")
VALVE_DNS = ("15", "20", "25", "32", "40", "50", "65", "80", "100", "125", "150")

# Families and the beginnings of the words that name them.
FAMILIES = {
    "adapter": ("adapter",), "chugun_fason": ("vchshg", "tyton"), "elbow": ("otvod", "koleno", "ugolnik", "ugol"), "filter": ("filtr",), "flange": ("flanec",), "grooved": ("gruvlok",), "homut": ("homut",),
    "insulation": ("kflex", "k-flex", "energoflex", "superterm", "teploizol"), "compensator": ("kompensator", "gibk", "vstavk"), "kran": ("kran", "kshc"), "klapan": ("klapan",), "manometer": ("manometr",), "mixer": ("smesitel",),
    "mufta": ("mufta", "amerikank"), "patrubok": ("patrub", "pds", "pps", "pfg", "pfrk"), "perehod": ("perehod", "pereh"), "pipe": ("truba",), "pozharka": ("pozharnyi",), "radiator": ("radiator", "registr"), "rezba": ("rezba",),
    "revision": ("revizi", "prochistk"), "schetchik": ("schetchik", "vodomer", "rashodomer"), "sink": ("umyval", "moik"), "tee": ("troinik",), "zadvizhka": ("zadvizh",), "zatvor": ("zatvor",), "toilet": ("unitaz",), "zaglushka": ("zaglush",),
    "vozduhootvod": ("vozduhootvod", "vozdnhootvod", "vozdootvod", "vozdushnik"),
}
FAMILY_ANYWHERE = ("rezba",)
PRIMARY_FAMILIES = (
    "adapter", "chugun_fason", "compensator", "elbow", "filter", "homut", "gearbox", "insulation", "klapan", "kran", "manometer", "mixer", "mufta", "patrubok", "perehod", "pipe", "pozharka", "radiator", "revision", "schetchik", "sink", "tee", "toilet", "vozduhootvod",
    "zadvizhka", "zatvor", "zaglushka",
)
NON_BLOCKING_FAMILIES = ("rezba", "mixer", "siphon", "mufta", "grooved")
TRACKED_SUBTYPES = {"elbow": ("offset",)}

# Material classes by beginnings of words and by whole words, and the classes that "for" or "under" before a word rules out.
MATERIALS = {
    "stainless": (("nerzh", "inox"), ("aisi", "s30400", "s30403", "s31600", "s31603", "s32100", "sus304", "sus316", "sus321")), "steel": (("stal", "mat"), ("wcb", "09g2s", "vgp")), "cast_iron": (("chugun", "vchshg", "kovk"), ()),
    "brass": (("latun",), ()), "bronze": (("bronz",), ()), "copper": (("medn",), ("med",)), "polypropylene": (("poliprop",), ("ppr", "pp-r", "pilsa", "kalde")), "pvc": (("pvc", "pvh"), ("pvc-u", "u-pvc")),
    "ppu": (("penopoliuretan", "ppu"), ("ppu",)), "polyethylene": (("polietilen",), ("pe", "pe80", "pe100", "pnd", "hdpe", "pex", "pex-a", "pex-b", "pe-rt", "pert")),
}
GUARDED_MATERIALS = ("cast_iron", "polypropylene", "pvc", "polyethylene", "copper")
NOT_STEEL = ("stainless", "cast_iron", "polypropylene", "pvc", "polyethylene")
STEEL_PIPE_TOKENS = ("vgp", "vodogazoprovodnaya", "elektrosvarnaya", "spec10704", "spec10705")
# Grades with their class, the tokens that name them and the pieces of text that do.
GRADES = {
    "ss304": ("stainless", ("1.4301", "304", "s30400", "sus304", "08x18h10", "0cr18ni9"), ("08x18n10", "08x18h10", "1.4301")),
    "ss304l": ("stainless", ("1.4307", "304l", "s30403", "sus304l", "03x18h11", "00cr19ni10"), ("03x18h11", "00cr19ni10", "1.4307")),
    "ss316": ("stainless", ("1.4401", "316", "s31600", "sus316", "08x17h13m2", "0cr17ni12mo2"), ("08x17h13m2", "0cr17ni12mo2", "1.4401")),
    "ss316l": ("stainless", ("1.4404", "316l", "s31603", "sus316l", "03x17h14m2", "00cr17ni14mo2"), ("03x17h14m2", "00cr17ni14mo2", "1.4404")),
    "ss321": ("stainless", ("1.4541", "321", "s32100", "sus321", "08x18h10t", "0cr18ni10ti"), ("08x18n10t", "08x18h10t", "12x18n10t", "12x18h10t", "0cr18ni10ti", "1.4541")),
    "cs20": ("steel", ("mat20", "st20", "ct20"), ("st.20", "stalnoi", "stalnaya", "stalnye", "stalnyh", "stalnogo")),
    "cs09g2s": ("steel", ("09g2s", "mat09g2s"), ()),
}

# Abbreviations of search text and the words they stand for.
ABBREVIATIONS = {
    "chug": ("chugunnyi", "chugun"), "lat": ("latunnyi", "latun"), "nerzh": ("nerzhaveiushchii", "nerzhaveika"), "oc": ("ocinkovannyi", "ocinkovanaya"), "st": ("stalnoi", "stal"), "fl": ("flancevyi", "flanec"), "rez": ("rezbovoi", "rezba"),
    "svar": ("svarnoi", "svarka"), "shar": ("sharovoi",), "konc": ("koncentricheskii",), "pereh": ("perehod",), "poln": ("polnoprohodnoi",), "komb": ("kombinirovannyi",), "b/n": ("beznapornyi",), "b/shov": ("besshovnyi",), "p/privar": ("privarnoi",),
    "pp-r": ("polipropilen",), "pp-md": ("polipropilen",), "pp-h": ("polipropilen",), "ppr": ("polipropilen",), "pe-x": ("polietilen",), "pe-xa": ("polietilen",), "pex": ("polietilen",), "mp": ("metalloplastik",), "term": ("termostaticheskii",),
    "aksial": ("aksialnyi",), "regulir": ("reguliruiushchii",), "zap": ("zapornyi",), "bim": ("bimetallicheskii",), "alyum": ("aliuminievyi",), "vgp": ("vodogazoprovodnaya",), "esh": ("elektrosvarnaya",),
    "amerikanka": ("american_union", "union", "razemnoe", "soedinenie"), "fm": ("female_male",), "ff": ("female_female",), "mm": ("male_male",),
}
# Standards that others replaced, with the words of the newer one.
REPLACED_STANDARDS = {"12820": ("spec33259", "type01", "subtypeflat"), "12821": ("spec33259", "type11", "subtypeweld")}

# Order of the tags that search text is extended by: measures first, pairs, families, the rest.
MEASURE_TAGS = ("dn", "pn", "type", "exec", "face", "hole", "mat", "spec", "od", "wall", "deg", "series", "kvs", "lmm")
PAIR_TAGS = ("pairdn", "tripledn")
WORD_TAGS = (
    "subfamily", "subtype", "shape", "connection", "operator", "for_family", "mounting_pad", "stem_square", "compatible_dn", "turn_type", "actuator", "handle", "extra_connection", "brand", "body_material", "disc_material", "conn_gender", "meter_type", "interface", "pulse_output",
    "pressure_range_mpa", "connection_guess", "connection_position", "accuracy_class", "orientation", "face_to_face", "has_magnet", "filter_element",
)

# Tags of the aliases that rule files name.
ALIAS_TAGS = {
    "female_female": ("conn_gender:ff",), "female_male": ("conn_gender:fm",), "male_male": ("conn_gender:mm",), "butterfly_handle": ("handle:butterfly",), "lever_handle": ("handle:lever",), "american_union": ("extra_connection:union",), "grooved": ("connection:grooved",),
    "magnetic_insert": ("has_magnet:true",), "mesh_strainer": ("filter_element:mesh",), "rubber_wedge": ("subtype:rubber_wedge",), "handwheel": ("actuator:handwheel",), "electric_actuator": ("actuator:electric",), "gearbox_operator": ("operator:gearbox",),
    "before_meter": ("subfamily:pds",), "after_meter": ("subfamily:pps",), "flange_plain_end": ("subfamily:pfg",), "combined_meter": ("meter_type:combined",), "turbine_meter": ("meter_type:turbine",), "impeller_meter": ("meter_type:impeller",), "pulse_output": ("pulse_output:true",),
    "rs485": ("interface:rs-485",), "flange_gost_33259": ("family:flange", "spec:33259"), "flange_flat_welded": ("family:flange", "type:01"), "flange_weld_neck": ("family:flange", "type:11"),
}
FAMILY_NAMES = {"manometr": "manometer"}
ARMATURE = ("zatvor", "zadvizhka", "kran", "klapan")

# Bonus for equal and penalty for different values of a tag's key.
DIMENSION_WEIGHTS = {
    "dn": (10.0, 22.0), "inch": (10.0, 22.0), "od": (14.0, 40.0), "pairdn": (18.0, 32.0), "tripledn": (34.0, 48.0), "type": (10.0, 16.0), "exec": (8.0, 12.0), "face": (6.0, 10.0), "hole": (4.0, 8.0), "wall": (8.0, 12.0), "deg": (8.0, 18.0), "series": (6.0, 10.0),
    "mat": (8.0, 12.0), "spec": (8.0, 8.0), "pn": (6.0, 12.0), "kvs": (6.0, 12.0), "lmm": (6.0, 12.0), "subfamily": (10.0, 16.0), "subtype": (8.0, 12.0), "shape": (8.0, 12.0), "connection": (6.0, 10.0), "actuator": (6.0, 10.0), "handle": (4.0, 8.0),
    "extra_connection": (4.0, 8.0), "conn_gender": (6.0, 10.0), "meter_type": (10.0, 16.0), "interface": (4.0, 8.0), "pulse_output": (4.0, 8.0), "pressure_range_mpa": (10.0, 18.0), "operator": (6.0, 10.0), "for_family": (8.0, 12.0), "mounting_pad": (10.0, 14.0),
    "stem_square": (10.0, 14.0), "compatible_dn": (12.0, 18.0), "turn_type": (8.0, 12.0), "body_material": (4.0, 8.0), "disc_material": (4.0, 8.0), "connection_guess": (4.0, 8.0), "connection_position": (4.0, 8.0), "accuracy_class": (4.0, 8.0), "orientation": (4.0, 8.0),
    "face_to_face": (4.0, 8.0), "has_magnet": (8.0, 12.0), "filter_element": (6.0, 10.0),
}
# Further weights by family: for equal keys, for different ones, and for keys that only the item has.
FAMILY_PROFILES = {
    "flange": ({"dn": 8.0, "pn": 8.0, "type": 10.0, "spec": 8.0, "grade": 6.0, "face": 4.0, "exec": 4.0, "hole": 2.0}, {"dn": 16.0, "pn": 14.0, "type": 18.0, "spec": 10.0, "grade": 10.0, "face": 8.0, "exec": 8.0, "hole": 6.0}, {}),
    "tee": ({"tripledn": 18.0, "dn": 6.0, "mclass": 6.0, "grade": 4.0}, {"tripledn": 24.0, "dn": 12.0, "mclass": 10.0, "grade": 8.0}, {}),
    "perehod": ({"pairdn": 18.0, "dn": 6.0, "mclass": 6.0, "grade": 4.0, "conn_gender": 6.0, "subtype": 6.0}, {"pairdn": 24.0, "dn": 12.0, "mclass": 10.0, "grade": 8.0, "conn_gender": 10.0, "subtype": 10.0}, {"conn_gender": 6.0, "subtype": 6.0}),
    "pipe": ({"od": 12.0, "wall": 12.0, "spec": 10.0, "mclass": 8.0, "grade": 6.0}, {"od": 18.0, "wall": 18.0, "spec": 12.0, "mclass": 12.0, "grade": 10.0}, {}),
}

# Keys of the learned profile and of packed structure keys, most telling first.
PROFILE_KEYS = ("family", "tripledn", "pairdn", "dn", "od", "wall", "pn", "mclass", "grade", "spec", "connection", "conn_gender", "subtype", "type", "deg", "series", "lmm")
STRUCTURE_PRIORITY = ("tripledn", "pairdn", "dn", "od", "inch", "wall", "pn", "mclass", "grade", "connection", "conn_gender", "subtype", "shape", "type", "exec", "face", "hole", "spec", "deg", "series", "kvs", "lmm")

# What makes a pair exact or an analog in words, by family.
EXACT_REASONS = {"pipe": "совпали тип трубы, размер и ГОСТ", "tee": "совпали тип изделия и тройные размеры", "perehod": "совпали тип изделия и обе стороны перехода", "": "совпали обязательные технические параметры"}
ANALOG_REASONS = {
    "compensator": "совпали семейство и DN, нужна ручная проверка исполнения", "filter": "совпали семейство и DN, нужна ручная проверка исполнения", "kran": "совпали семейство и размер, нужна ручная проверка исполнения",
    "manometer": "совпали семейство и ключевые параметры, нужна ручная проверка исполнения", "patrubok": "совпали семейство, подтип и DN", "pozharka": "совпали семейство и основные размеры, нужна ручная проверка",
    "revision": "совпали семейство и DN, нужна ручная проверка исполнения", "schetchik": "совпали семейство и ключевые параметры счетчика, нужна ручная проверка", "chugun_fason": "совпали семейство и DN, нужна ручная проверка исполнения",
    "gearbox": "совпали семейство и ключевые параметры редуктора", "vozduhootvod": "совпали семейство и DN, нужна ручная проверка исполнения", "zatvor": "совпали семейство и ключевые размеры, нужна ручная проверка",
    "zadvizhka": "совпали семейство и DN, нужна ручная проверка исполнения", "": "совпали обязательные параметры семейства, нужна ручная проверка",
}
# Reason of each rule of the decision that names none of its own.
RULE_REASONS = {
    0: "ничего не нашлось", 1: "совпал код/марка", 3: "совпали тип трубы, размер и ГОСТ", 4: "высокая уверенность", 5: "совпали тип изделия и тройные размеры", 6: "совпали ключевые слова и размеры", 8: "нужна ручная проверка",
    9: "высокое пересечение ключевых слов, нужна ручная проверка", 10: "сильное совпадение по исполнению и размерам, нужна ручная проверка", 11: "совпадают ключевые слова и размеры, нужна ручная проверка",
    12: "совпадают тип изделия и размеры, нужна ручная проверка", 13: "совпадают размеры и тип, нужна ручная проверка", 14: "совпадают размеры, нужна ручная проверка", 15: "совпал код/марка, нужна ручная проверка",
    16: "размеры совпадают, но низкое пересечение текста, нужна ручная проверка", 17: "подходящего совпадения нет",
}
DEPLETED_REASON = "позиция нашлась, но её остаток уже ушёл на предыдущие строки"
PARTIAL_SUFFIX = "; на остатке меньше, чем запрошено"
UNREADABLE = "Не найден доступный extractor для документа"
# What a manager does next, by status.
ACTIONS = {"found": "Загрузить в 1С", "safe": "Подтвердить аналог", "approval": "Согласовать замену", "manual": "Ручной подбор", "depleted": "Проверить остаток", "none": "Нет в остатке"}
APPROVED_STATUS = "Одобрена замена"
