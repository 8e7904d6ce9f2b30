import pytest

from semframe.llm import encoding


def damaged(text, read, times):
    table = encoding.char_of("w1252" if read == "cp1252" else read)
    for _ in range(times):
        text = "".join(chr(b) if b < 0x80 else table.get(b, chr(b)) for b in text.encode())
    return text


TEXTS = {
    "emoji": "Works 😀 again, σ=3", "ru": "Решение: шум, ИТОГ и учёт — у Шуры.", "el": "Σήμερα ο σκύλος έφυγε στις σκάλες.", "he": "שלום לכולם, הקובץ פתוח.", "ar": "مرحبا و شكرا، الملف مفتوح.",
    "th": "ไฟล์นี้เปิดไม่ได้", "hi": "फ़ाइल खुल नहीं रही है।", "vi": "Tệp này không mở được ở Việt Nam.", "ro": "Fișierul și informația națională țin.", "marks": "café und über",
}


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("lang", TEXTS)
def test_scripts_and_repeated_damage(lang, times):
    kind, back = encoding.examine("Sound line.\n" + damaged(TEXTS[lang], "cp1252", times))
    assert kind is not None and back == "Sound line.\n" + TEXTS[lang]


@pytest.mark.parametrize("read", ["cp1250", "cp1251", "cp437", "mac_roman"])
def test_russian_twice(read):
    assert encoding.examine(damaged(TEXTS["ru"], read, 2))[1] == TEXTS["ru"]


@pytest.mark.parametrize("text", [
    "CAFÉ® and BRÜ™ of JOSÉ’s", "“Él dijo «está»”", "Æ’s album", "Ø½in pipe, 3×½in", "П’ЯТЬ М’ЯСО", "У ЛІТІ ДІЇ ТІЛО", "╔═════╗\n╠═╣╔╗╔╗\n╚═════╝", "дії Ні Мі Ці", "groß… weiß™", "DÉJÀ² É¹ Ñ°",
    "שלום לכולם", "ไฟล์นี้", "Fișierul și țin", "Việt Nam được",
])
def test_sound_texts_with_chance_spans(text):
    assert encoding.examine(text) == (None, None)


def test_letters_of_another_cyrillic_encoding_are_no_evidence():
    said = "Ссылка для входа открывается медленно. Подскажите, кто отвечает за это?"
    text = "Страница пуста.\n" + said.encode("koi8_r").decode("cp1251")
    assert encoding.examine(text) == ("koi8_r read as cp1251", "Страница пуста.\n" + said)


def test_lower_case_damage_is_no_rare_letter():
    assert encoding.examine("c’est prãªt : rã©ponds, dã©jã\u00a0 prãªt".lower())[0] == "utf-8 read as w1252 in lower case"


def test_romanian_by_box_drawings():
    assert encoding.examine(damaged(TEXTS["ro"], "cp437", 1))[1] == TEXTS["ro"]


def test_russian_twice_is_not_read_as_shift_jis():
    said = "Подскажите, кто отвечает за это с прошлой недели? Почему ссылка показывает 17 вместо 3120?"
    assert encoding.examine(damaged(said, "cp1252", 2)) == ("utf-8 read as w1252", said)


@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437"])
@pytest.mark.parametrize("times", [3, 6, 9])
def test_any_number_of_readings(read, times):
    text = "M\u00fcller \u00fcber Stra\u00dfe, d\u00e9j\u00e0 vu"
    route, kind, back = encoding.examined(damaged(text, read, times))
    assert route == encoding.AUTOMATON and back in (text, None)
    if read == "cp1252":
        assert back == text


def test_no_restoration_with_controls():
    said = "M\u00fcller \u00fcber Stra\u00dfe"
    for times in range(1, 9):
        for lose in ("replace", "ignore"):
            text = said
            for _ in range(times):
                text = text.encode().decode("cp1252", lose)
            back = encoding.examine(text)[1]
            assert back is None or not any(c < " " for c in back)
