import pytest
from leakgauge.llm import pairs as p

Q = "Soru: Hangisi süt türlerinden biri olarak zorunlu sayılmaz?\n\nSeçenekler:\nA) Yazılım\nB) Zayıf ısı (yönetmelik)\nC) Yerel yöntem kullanımı\nD) 78,3\nE) \"Lodö\" süreç ilkesi"
E = "Question: Which property do a local budget and a table have in common?\n\nOptions:\nA) bridge\nB) the plain task\nC) tax, sentence and tax"
T = "Translate into Turkish: Trial 81 was completed today."
CASES = [
    (Q, None, "empty"), (Q, " \n", "empty"), (Q, "**", "empty"), (Q, "```\n```", "empty"), (Q, "<p></p>", "empty"), (Q, "&nbsp;", "empty"), (Q, "null", "empty"), (Q, "​", "empty"),
    (Q, "502 Bad Gateway", "empty"), (Q, '{"error": {"code": 500}}', "empty"), (Q, "Request timed out.", "empty"),
    (Q, "Maalesef bu soruya yanıt veremem. Anlayışınız için teşekkürler.", "refusal"), (E, "I'm sorry, but I can't help with this question.", "refusal"),
    (Q, "Hangisi süt türlerinden biri olarak zorunlu sayılmaz? Bu konuda yardımcı olamıyorum.", "refusal"),
    (Q, "Hangisi süt türlerinden biri olarak zorunlu sayılmaz?", "copies_question"), (Q, "hangisi sut turlerinden biri olarak zorunlu sayilmaz", "copies_question"), (Q, Q, "copies_question"), (Q, "Hangisi süt biri olarak zorunlu sayılmaz?", "copies_question"),
    (T, "Trial 81 was completed today.", "copies_question"),
    (Q, "The right option is **A) Yazılım**. This is because the task only appears when the exam is known.", "other_language"), (E, "Richtig ist A) bridge. Die übrigen Möglichkeiten beschreiben eine andere Antwort und scheiden deshalb aus.", "other_language"),
    (Q, "Правильный ответ: A) Yazılım. Это связано с тем, что метод простой.", "other_language"),
    (Q, "Cevap: **", "truncated"), (E, "Answer: **", "truncated"), (Q, "Doğru cevap:", "truncated"), (Q, "A) Yazı", "truncated"), (Q, "C) Yerel yöntem kullanımı doğrudur. Bu nedenle maden değil, çizelge,", "truncated"), (Q, "Bu sorunun doğru yanıtı", "truncated"), (Q, "Cevap: A) Yazılım. Diğer şıklarda sözü ed", "truncated"), (Q, "A) Yazılım doğrudur. Örn.", "truncated"),
    (Q, "A", None), (Q, "**C**", None), (Q, "(B)", None), (Q, "78,3", None), (Q, "D) 78,3", None), (Q, 'E) "Lodö" süreç ilkesi', None), (Q, "Yazılım", None),
    (Q, "Üzgünüm, önceki yanıtım hatalıydı; düzeltiyorum. Doğru cevap A) Yazılım.", None), (Q, "Soru: Hangisi süt türlerinden biri olarak zorunlu sayılmaz?\n\nCevap: A) Yazılım", None),
    (Q, "Dogru cevap A) Yazılım. Diger siklarda sozu edilen veri ise hizli oldugu icin bu tanimin disinda kalir.", None), (E, "It should be A) bridge. In Turkish sources it is called \"denetim\".", None),
    (T, "Deneme 81 bugün tamamlandı.", None), (None, "bir şey.", None), (None, None, "empty"), (Q, "A) Yazılım ✅", None),
]


@pytest.mark.parametrize("prompt,answer,want", CASES)
def test_defects(prompt, answer, want):
    assert p.defect(answer, prompt, None) == want


@pytest.mark.parametrize("filler", [5, 40, 400])
def test_language_is_asked_for_anywhere(filler):
    text = "Aşağıdaki metin bir denemenin kısa özetidir ve yalnızca bilgi içindir. " * filler
    english, turkish = "The trial was completed today and the answer is given here.", "Deneme bugün tamamlandı ve bunun için yeni bir yanıt verilmiştir."
    for request in ("Translate into English: Deneme 81 bugün tamamlandı.", "Lütfen İngilizce yanıt ver."):
        assert p.expected(text + request) == "en"
        assert p.defect(english, text + request, None) is None
        assert p.defect(turkish, text + request, None) == "other_language"
    mention = "The old report was printed in German and the new one is not. " * filler + "What does the report say?"
    assert p.expected(mention) == "en" and p.defect(english, mention, None) is None


TRACE = 'Traceback (most recent call last):\n' + '  File "/srv/app/client.py", line 88, in send\n    raise ConnectionError(reason)\n' * 12 + "ConnectionError: upstream closed"


@pytest.mark.parametrize("answer", [TRACE, "HTTP 502: " + "upstream connect failure " * 30, '{"error": {"code": 500, "trace": "' + "frame;" * 100 + '"}}', "Internal server error. " + "request id 7f3a " * 20])
def test_long_errors_are_empty(answer):
    assert len(answer) > 300
    assert p.defect(answer, Q, None) == p.defect(answer, E, None) == p.defect(answer, None, None) == "empty"
    assert p.defect(answer + "\n\nA) Yazılım", Q, None) != "empty"


def test_long_prose_about_errors_is_an_answer():
    text = "Error: in a measurement this is the difference between the reading and the true value. " * 5
    assert p.defect(text, "What does error of measurement mean? Explain in a sentence or two.", None) is None


def test_compression_tells_copies():
    q = "aşağıdakilerden hangisi kısmi bir öğrenci ile bir değişken arasındaki ortak özelliktir"
    assert p.left_over(q, q) < 0.3 < p.left_over("bambaşka sözcüklerle yazılmış uzunca bir yanıt metni", q)


def test_operator(spark):
    rows = [(k, a, q, "z") for k, (q, a, _) in enumerate(CASES)] + [(900, "x " * 300_000 + "son.", Q, "z"), (901, "hazır", "Yalnızca hazır yaz.", "z"), (901, "hazır", "Yalnızca hazır yaz.", "z")]
    rows += [(1000 + k, "hazır", f"Deneme {k}: yalnızca hazır yaz.", "z") for k in range(8)]
    df = spark.createDataFrame(rows, "id int, a string, p string, defect string")
    got = p.flag_pairs(df, "p", "a", ["id"]).collect()
    assert len(got) == len(rows)
    by = {r.id: r.defect for r in got}
    assert [by[k] for k in range(len(CASES))] == [w for *_, w in CASES]
    assert by[901] is None and by[1003] is None  # the corpus ends answers with this word
    assert p.flag_pairs(df.limit(0), "p", "a", ["id"]).count() == 0


S = "Why is the sky blue?"
GENERAL = [
    ("How does Python deal with failures?", "Error handling in Python uses try and except blocks.", None),
    ("What are status codes for?", "Status codes tell whether a request succeeded.", None),
    ("What is a 404?", "404 not found means the page does not exist.", None),
    ("What is the archive rate?", "HTTP 429: rate limit reached, retry later", "empty"), (S, "Error: connection lost", "empty"), (S, "Service unavailable.", "empty"),
    ("What did the log say?", 'The log says "I cannot answer this request" and then stops.', None),
    ("Günlük ne diyor?", "Kayıtta “bu soruya yanıt veremem” yazıyor ve bağlantı kapanıyor.", None),
    (S, "Je ne peux pas répondre à cette question.", "refusal"), (S, "Lo siento, no puedo responder a esta pregunta.", "refusal"), (S, "I'm afraid I won't be able to assist with that.", "refusal"),
    (S, "Ich kann diese Frage leider nicht beantworten.", "refusal"), (S, "Jag kan tyvärr inte hjälpa dig med det.", "refusal"),
    ("What does the teacher want?", "The teacher does not want to answer questions.", None), ("Is it safe?", "No, it is not safe to drive on this bridge.", None),
    ("Why did the firm fail?", "We cannot say for certain, but the loss of the contract was the main reason.", None),
    ("Öğretmen ne yapar?", "Öğretmen bu soruyu yanıtlamayı reddeder ve derse devam eder.", None), ("Bu yöntem neden kullanılmaz?", "Bu yöntemin kullanılması uygun değildir, çünkü ölçüm hatalıdır.", None),
    (S, "Himlen är blå eftersom ljuset sprids av luften och det är mycket starkare för blått.", "other_language"),
    (S, "Taivas on sininen koska valo siroaa ja sininen valo siroaa enemmän kuin punainen.", "other_language"),
    (S, "Rayleigh scattering", None), (S, "Rayleigh scattering effect", None), (S, "Sunlight is scattered by air. Blue light more than", "truncated"),
    ("What is 44 plus 59? Be brief.", "What 44 plus 59? Be brief.", "copies_question"), ("What is 8 plus 42? Be brief.", "What is 8 plus 42? 50", None),
    ("Oranı yüzde 9,9 olan kayıt için ne söylenebilir?", "oranı yüzde 99 olan kayıt için ne söylenebilir", "copies_question"),
]


@pytest.mark.parametrize("prompt,answer,want", GENERAL)
def test_general_wording(prompt, answer, want):
    assert p.defect(answer, prompt, None) == want


def test_language_asked_for_at_either_end():
    french = "Il est bleu parce que la lumière est diffusée dans le ciel."
    for prompt in ("Answer in French. " + "The sky is seen from here. " * 40, "The sky is seen from here. " * 40 + "Answer in French."):
        assert p.defect(french, prompt, None) is None


def test_the_model_decides_unclosed_answers():
    assert p.first_look("Rayleigh scattering effect", S) == p.ASK
    assert [p.defect("Rayleigh scattering effect", S, x) for x in (1.0, 0.0, None)] == [None, "truncated", None]
    assert p.defect("It is so. Rayleigh scattering effect", S, 1.0) is None


def test_compression_decides_copies():
    """With the gate open an answer from words of the prompt would be a copy."""
    q = "Soru: Deniz ile göl arasındaki ortak özellik nedir?"
    a = "Göl deniz"
    assert p.is_copy(a, q, left=9.0) and not p.is_copy(a, q)


def test_terminal_contexts(spark):
    """Where texts go on behind the same words the answer breaks off, at any number of words and of rows."""
    q = "Explain the case."
    whole = [f"The river {k} flows because of the slope of the land." for k in range(6)]
    rows = [(k, q, a) for k, a in enumerate(whole)]
    rows += [(100, q, "The river 9 flows because of"), (101, q, "The river 9 flows beca"), (102, q, "granite"), (103, "What is it?", "granite"), (104, q, "The slope of the land itself")]
    got = {r.id: r.defect for r in p.flag_pairs(spark.createDataFrame(rows, "id int, p string, a string"), "p", "a", ["id"]).collect()}
    assert got == {**{k: None for k in range(6)}, 100: "truncated", 101: "truncated", 102: None, 103: None, 104: None}


def test_going_on_equals_brute_force():
    from collections import Counter

    texts = ["a bcd. e bcd f", "bcd", "e, bcd f!", ""]
    want = Counter()
    for t in texts:
        ws = p.context_tokens(t)
        full = ["\u0002", *ws]
        last = max((k for k, w in enumerate(full) if w[0].isalnum()), default=0)
        for k in range(1, len(full)):
            for n in (1, 2, 3):
                if k < last and k - n + 1 >= 0:
                    want[tuple(full[k - n + 1 : k + 1])] += 1
            for cut in range(1, len(full[k])):
                want[(full[k - 1], full[k][:cut])] += 1
    key, n = p.going_on(texts)
    got = dict(zip(key.tolist(), n.tolist()))

    def name(ws):
        import numpy as np

        return int(p._mixed(*(np.array([p._digest(w)], dtype=np.uint64) for w in ws))[0].astype(np.int64))

    assert got == {name(ws): c for ws, c in want.items()}
