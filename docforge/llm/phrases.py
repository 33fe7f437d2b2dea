"""Refusals, answers that look like refusals, and stand-ins, put together from parts; and the words that hint at them.

Nothing here is a sentence of any table: the parts are common words of five languages, and a test checks that none of the
sentences that the grammar makes occurs in the test tables.
"""

from __future__ import annotations

import random

# Common words of five languages by what they do in a refusal.
_CUES = {
    "self": "m i i'm i'd i'll i've my me myself we our us assistant model ai bot service ich mir mich mein meine wir uns je j'ai me moi mon ma nous yo mi me mis nosotros 我 我们 本助手",
    "sorry": "sorry apologies apology apologise apologize afraid unfortunately regrettably regretfully sadly regret leid leider bedaure bedauere entschuldigung verzeihung bedauerlicherweise désolé désolée pardon malheureusement regrette hélas siento lamento perdón disculpe disculpas lamentablemente desafortunadamente 抱歉 对不起 遗憾 不好意思",
    "unable": "n can't cannot couldn't won't wouldn't unable impossible incapable not isn't don't doesn't no never nothing without nicht kein keine keinen nie unmöglich außerstande ne n'est pas non aucun aucune impossible incapable jamais no ningún ninguna imposible incapaz nunca 无法 不能 不会 不可 没有 不",
    "decline": "decline declined declining refused rejected refuse refusing refusal reject avoid rather pass stop refrain withhold against rules rule policy policies guidelines instructions forbid forbids forbidden allow allowed permit permitted prevents prevent beyond outside limits ablehnen verweigern richtlinien regeln untersagt erlaubt darf dürfen refuser refuse règles politique interdit autorisé permis hors rechazar niego reglas política prohibido permitido fuera 拒绝 规定 不允许 不便 超出 范围 政策",
    "help": "help assist support comply answer answering respond reply comment discuss speculate guess advise advice provide offer produce write explain evaluate assess judge summarise request requests question questions conversation chat dialogue topic subject matter helfen beantworten antworten unterstützen äußern anfrage frage thema aider répondre assister commenter demande question sujet ayudar responder contestar comentar petición pregunta tema 回答 帮助 协助 提供 评论 讨论 问题 请求",
    "refer": "consult ask contact turn expert experts specialist specialists engineer professional human person colleague someone else anything other another wenden fachkraft fachleute experten spezialisten adressez adresser consultez expert spécialiste consulte acuda experto especialista 咨询 请教 专家 专业 人士",
    "views": "see find know think believe expect aware imagine agree sehe finde weiß denke glaube erwarte vois trouve sais pense crois veo encuentro sé pienso creo 看到 发现 认为 同意",
}
CUES: dict[str, int] = {}
for _k, _ws in enumerate(_CUES.values()):
    for _w in _ws.split():
        CUES[_w] = CUES.get(_w, 0) | (1 << _k)
HAN_CUES = [(w, bit) for w, bit in CUES.items() if "\u3400" <= w[0] <= "\u9fff"]
# Words that speak of an absent text.
ABSENT = frozenset(
    "n a na none null nil nan tbd tba tbc todo to be done determined decided defined provided completed confirmed added supplied filled empty blank missing unknown undefined unspecified pending placeholder void nothing no not any yet "
    "response answer reply text content data comment comments input value entry available applicable given specified recorded x xx xxx k keine kein antwort angabe angaben text entfällt offen aucune aucun réponse néant sans objet vide "
    "sin respuesta ninguno ninguna nada aplica vacío pendiente 无 没 有 暂 未 待 定 空 回 答 复 内 容 提 供 填 写".split()
)

# The grammar. A part is chosen at each brace; {x} is what was asked about.
_PARTS = {
    "en": {
        "sorry": "Sorry|My apologies|I regret this|I am truly sorry|Regretfully|With regret|Unfortunately|I am afraid",
        "cannot": "I can not|I cannot|I can't|I am unable to|I won't|I will have to refuse to|I am not in a position to|I am not permitted to|it is impossible for me to|I would prefer not to|this service cannot|we are not allowed to|I'm not able to|I do not want to|I must refrain from trying to",
        "do": "answer|respond to|discuss|comment on|assist with|help with|write about|evaluate|advise on|explain|speculate about|say anything on|judge|provide an opinion on",
        "it": "that question|your question|this sort of request|such matters|{x}|that subject|anything concerning {x}|the security of {x}|weak points of {x}|this one",
        "why": "it goes beyond what I may do|I lack the knowledge|my instructions forbid it|the rules of this service exclude it|that could do harm|I have seen no document on it|this is not a safe topic",
        "who": "a specialist|someone qualified|an experienced colleague|your own experts|a human advisor|the responsible people",
        "noun": "reply|comment|statement|assessment|opinion|advice|explanation",
        "doing": "answering|judging|writing about|commenting on|helping with|looking into",
        "we": "this assistant|the model|an assistant like me|the service|your assistant|a program like me",
        "skip": "has to leave {it} alone|must skip {it}|would rather skip {it}|cannot take {it} on|gives no {noun} on {it}|has to say no",
        "notmine": "is not what I am for|is nothing that I do|is not part of my work|is no task for me|does not suit me|is not allowed here",
        "talk": "talk|chat|conversation|exchange|dialogue",
        "made": "given|offered|made|expected from me|provided",
        "": "{sorry}, but {cannot} {do} {it}.|{cannot} {do} {it}.|{cannot} {do} {it}, since {why}.|{cannot} {do} {it}; {why}.|{sorry}: {why}.|As {why}, {cannot} {do} {it}.|No {noun} on {it} can be {made}.|No {noun} will be {made} here.|Please ask {who} about {it}.|Better turn to {who}.|For {it}, {who} should be asked instead of me.|Can I support you with some other matter?|Would you like to raise a different subject?|Any {noun} on {it} is beyond my remit.|Discussing {it} lies outside of my limits.|{sorry}, {we} {skip}.|{sorry} {we} {skip}.|{doing} {it} {notmine}.|{sorry}, {doing} {it} {notmine}.|This {talk} on {it} has to end.|This {talk} about {it} can't proceed.|The {talk} can not go on with {it}.|We cannot go on with a {talk} on {it}.|You should rather ask {who}.|It would be better to ask {who} instead.|You could try {who}.|I refuse.|I won't.|Refused.|Your request is rejected by this assistant.|{it} is something that {cannot} {do}.|I stop at this point.|I end this chat here.|The dialogue about {it} is over.|I decline this request.|We do not {do} {it}.|My rules do not permit a {noun} on {it}.",
    },
    "de": {
        "sorry": "Entschuldigung|Leider|Ich bedaure|Es tut mir sehr leid|Verzeihung|Bedauerlicherweise",
        "it": "diese Frage|diesen Wunsch|{x}|ein solches Thema|die Schwächen von {x}",
        "do": "beantworten|bearbeiten|bewerten|besprechen|kommentieren|erklären",
        "": "{sorry}, ich kann {it} nicht {do}.|{sorry}, {it} darf ich nicht {do}.|Ich bin nicht in der Lage, {it} zu {do}.|Ich möchte {it} lieber nicht {do}.|Das liegt außerhalb meiner Möglichkeiten.|Bitte fragen Sie Fachleute zu {it}.|Meine Regeln erlauben mir keine Auskunft.|Ich lehne das ab.|Dabei helfe ich nicht.",
    },
    "fr": {
        "sorry": "Pardon|Malheureusement|Toutes mes excuses|Je regrette|Hélas",
        "it": "cette question|cette requête|{x}|un tel sujet|les faiblesses de {x}",
        "do": "traiter|commenter|évaluer|aborder|expliquer",
        "": "Il m’est interdit de {do} {it}.|Il ne m’est pas possible de {do} {it}.|{sorry}, je ne peux pas {do} {it}.|{sorry}, je ne suis pas en mesure de {do} {it}.|Il ne m'est pas permis de {do} {it}.|Je refuse de {do} {it}.|Je préfère ne pas {do} {it}.|Cela dépasse mes capacités.|Veuillez demander à un expert.|Mes règles m'interdisent de {do} {it}.",
    },
    "es": {
        "sorry": "Perdón|Lamentablemente|Mis disculpas|Lo lamento|Desafortunadamente",
        "it": "esta pregunta|esa solicitud|{x}|un tema así|los puntos débiles de {x}",
        "do": "tratar|comentar|evaluar|abordar|explicar",
        "": "{sorry}, no puedo {do} {it}.|{sorry}, no estoy en condiciones de {do} {it}.|No se me permite {do} {it}.|Me niego a {do} {it}.|Preferiría no {do} {it}.|Eso supera mis capacidades.|Por favor, pregunte a una persona experta.|Mis reglas me prohíben {do} {it}.",
    },
    "zh": {
        "sorry": "对不起|不好意思|非常抱歉|遗憾的是",
        "it": "这类问题|您的请求|{x}|这个话题|{x}的弱点",
        "do": "讨论|评价|解释|处理|评论",
        "": "{sorry}，我不能{do}{it}。|{sorry}，我没有办法{do}{it}。|我无权{do}{it}。|我拒绝{do}{it}。|请向专业人员询问{it}。|按照规定，我不可以{do}{it}。|这不在我的职责之内。",
    },
}
_LOOK = {
    "part": "unit|server|peer|module|agent|controller|node|buffer",
    "fails": "cannot|is unable to|does not|refuses to|declines to|is not permitted to|will not",
    "acts": "answer|accept|comply with|process|help|serve|forward|respond to",
    "what": "the request|that message|such a query|the call|any question of the peer|{x}",
    "then": " while {x} is absent|, which is now stated|; this is kept| and reports an error instead| before the timer has run out|, so a rule is added",
    "see": "can see|do not see|can't imagine|cannot find|know of no|see no|would not expect|could not think of|am not aware of",
    "else": "another place|any further conflict|a different reading|any effect on others|more places that use {x}",
    "for": "for the slow answer|for replying after the deadline|for the delayed comment to all|for the wrong number before|for my earlier slip|for being late|about the missing annex",
    "": "The {part} {fails} {acts} {what}{then}.|A {part} {fails} {acts} {what} and {fails} {acts} {what}{then}.|I {see} {else}.|I {see} {else} with {x}.|I {see} {else} where {x} is needed.|Sorry {for}: only {x} is touched.|Sorry {for}: this update concerns {x} and nothing else.|Sorry {for}; we limit ourselves to {x}.|Apologies {for}; the text on {x} stays.|We are not able to keep the old words on {x}, hence the reference.|I cannot agree to remove {x}, so it is moved.|No reply is sent to the {part}{then}.|The {part} is asked to refuse {what}{then}.|I would rather keep {x} as it is, with a note.|Nothing else has to be done.|No update of {x} is required.|No edit to {x} is intended here.|No further text on {x} is called for.|No other {part} uses {x}.|Nothing is changed for the {part}.|Yes, for {x} alone.|No, only the {part} does so.|Agreed.|Done as asked.|Not for {x}.",
}
_STAND = {
    "no": "no|not|No|None|NO",
    "text": "response|answer|reply|text|content|data|comment|input",
    "given": "available|applicable|provided|specified|given|recorded",
    "to": "determined|done|provided|decided|completed|defined",
    "": "n/a|N/A|NA|none|None|null|NULL|nil|NaN|tbd|TBD|T.B.D.|TBA|tbc|TODO|empty|blank|missing|unknown|pending|placeholder|void|nothing|x|xxx|XXX|{no} {text}|not {given}|Not {given}.|[{text}]|<{text}>|({text} missing)|no {text} yet|to be {to}|To be {to}.|{no} {text} {given}|undefined|[empty]|(none)|keine Antwort|keine Angabe|entfällt|k. A.|offen|aucune réponse|sans objet|néant|sin respuesta|no aplica|ninguna|pendiente|无|没有|暂无|待定|无回答|未填写|无内容",
}


def _filled(r: random.Random, parts: dict[str, str], text: str) -> str:
    while "{" in text.replace("{x}", ""):
        for name, choices in parts.items():
            if name and "{" + name + "}" in text:
                text = text.replace("{" + name + "}", r.choice(choices.split("|")), 1)
    return text


def refusal(r: random.Random, thing: str) -> str:
    """A sentence of a refusal, two times of three in English."""
    parts = _PARTS["en"] if r.random() < 0.65 else _PARTS[r.choice(("de", "fr", "es", "zh"))]
    text = _filled(r, parts, r.choice(parts[""].split("|"))).replace("{x}", thing)
    return text[0].upper() + text[1:]


def lookalike(r: random.Random, thing: str) -> str:
    """A sentence of a proper answer with the words of a refusal, or a short one."""
    return _filled(r, _LOOK, r.choice(_LOOK[""].split("|"))).replace("{x}", thing)


def stand_in(r: random.Random) -> str:
    return _filled(r, _STAND, r.choice(_STAND[""].split("|")))
