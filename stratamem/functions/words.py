"""Word lists of the text functions."""

ENGLISH_STOP = frozenset("the of and to a in is it its that was for on are as with he be at by were has an will from".split())

ITALIAN_STOP = frozenset(
    """
    il lo la li le gli un uno una e ed ma se che chi cui non come dove dov anche perché più è
    a ad al allo alla all agl agli ai alle con col coi da dal dallo dalla dall dagl dagli dai dalle
    di del dello della dell degl degli dei delle in nel nello nella nell negl negli nei nelle
    su sul sullo sulla sull sugl sugli sui sulle per tra contro
    io tu lui lei noi voi loro mi ti ci vi si ne
    mio mia mie miei tuo tua tue tuoi suo sua sue suoi nostro nostra nostre nostri vostro vostra vostre vostri
    quale quanto quanta quante quanti quello quella quelle quelli questo questa queste questi
    ho hai ha hanno abbiamo avete abbia abbiano abbiate avevo avevi aveva avevano avevamo avevate
    avrò avrà avrai avremo avrete avranno avrei avrebbe avresti avremmo avreste avrebbero
    ebbi ebbe ebbero avesti avemmo aveste sono sei siamo siete sia siano siate
    ero eri era erano eravamo eravate fui fu furono fosti fummo foste
    sarei sarebbe saresti saremmo sareste sarebbero sto sta stai stiamo state stanno
    """.split()
)

#: Dropped by compression: articles, weak auxiliaries, plain prepositions.
ENGLISH_SAFE = frozenset("am is are was were be been being have has had do does did shall should will would a an the about at by for from in of on to with as its".split())
ITALIAN_SAFE = frozenset(
    """
    gli i il la le lo un una uno a con da di fra in per su tra
    agli ai al alla alle allo coi col dagli dai dal dalla dalle dallo degli dei del della delle dello
    negli nei nel nella nelle nello sugli sui sul sulla sulle sullo
    era erano è abbiamo avete ha hai hanno ho sta stai stanno state stiamo sto
    """.split()
)

#: Never dropped, in either language: negations, connectives, quantifiers.
PROTECTED = frozenset(
    """
    no not none nothing never and or but if unless except all any each every only a i
    non mai niente nulla e ed o oppure ma però tuttavia se qualora eccetto tranne
    ciascuno ogni solo soltanto tutte tutti sia siano sono
    """.split()
)

#: Roots for the sentiment score.
POSITIVE = ("good", "great", "excellent", "love", "happy", "success", "improve", "helpful", "win", "perfect")
NEGATIVE = ("bad", "terrible", "hate", "sad", "fail", "error", "problem", "broken", "worse", "angry")
