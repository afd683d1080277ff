"""Given names, their short forms and titles, as fixed lists."""

from __future__ import annotations

# Common given names, each with its short forms and spellings.
GIVEN_NAMES = """
ABIGAIL: ABBY ABBIE GAIL
ALEXANDER: ALEX SASHA XANDER SANDY AL ALEC ALEKSANDER
ALICE: ALLIE ALYCE
AMY: AIMEE
ANDREI: ANDRE ANDREY ANDY
ANDREW: ANDY DREW
ANNA: ANN ANNE ANNIE ANA
ANTHONY: TONY ANTON ANTONY
BARBARA: BARB BABS BARBIE
BENJAMIN: BEN BENNY BENJI
BJÖRN: BJORN BJOERN
BRIGITTE: GITTE BRIGITTA BRIGIT BRITTA
CAROLINE: CARRIE CARO CAROLYN
CÉLINE: CELINE CELIA
CHARLES: CHARLIE CHUCK CHAS CHARLEY
CHRISTOPHER: CHRIS KIT TOPHER KRISTOPHER
DANIEL: DAN DANNY
DAVID: DAVE DAVY
DEBORAH: DEB DEBBIE DEBRA
DIANA: DIANE DI
DONALD: DON DONNY
DOROTHY: DOT DOTTIE DOLLY DOROTHEA
EDWARD: ED EDDIE NED TED EDUARD
ELIZABETH: LIZ BETH BETTY ELISABETH LIZZIE ELIZA LIBBY BETSY
EMILY: EM EMMY
FRANCES: FRAN FRANNIE FRANKIE FRANCIE
FRANK: FRANKLIN
FREDERICK: FRED FREDDY FREDDIE FREDERIC FREDRICK
GEORGE: GEORGIE
GERALD: JERRY GERRY GERARD
GIANNI: GIOVANNI GIAN
GRACE: GRACIE
HELEN: HELENA NELL
HELGA: HELGE OLGA
HENRY: HANK HARRY HAL HENRI
INGRID: INGE INGA
JACOB: JAKE
JAMES: JIM JIMMY JAMIE JEM
JANE: JANET JANIE
JENNIFER: JEN JENNY JENN
JOHN: JACK JOHNNY JON
JONATHAN: JON JONNY
JOSEPH: JOE JOEY JOS
JOSÉ: JOSE PEPE
JULIA: JULIE
KAREN: CAREN
KATHERINE: KATE KATHY CATHERINE KATIE KATHARINE KAT KATYA CATHY KITTY
KEIKO: KEI
LAURA: LAURIE
LAWRENCE: LARRY LAURENCE LARS LAURIE
LEILA: LEILAH LAYLA LEYLA LAILA
LINDA: LYNDA
LUCY: LUCIA
MARGARET: PEGGY MEG MAGGIE MARGE GRETA RITA MARGOT
MARIA: MARIE MARY
MARK: MARC MARCUS
MARTIN: MARTY
MICHAEL: MIKE MICK MICKEY MIKEY MICHEL
MOHSIN: MOHSEN MOSHIN MOHSSIN
NADIA: NADYA NADJA NADINE
NANCY: NAN
NATHANIEL: NATHAN NATE NAT
NICHOLAS: NICK NICKY NICOLAS NIKOLAS NICO
OLIVER: OLLIE OLIVIER
OLIVIA: LIV
PATRICIA: PAT TRISH PATTY PATSY TRICIA
PATRICK: PAT PADDY
PAUL: PAULIE
PETER: PETE PETRUS
PETRA: PET PETRINA
PHILIP: PHIL PHILLIP PIP FILIP
QUENTIN: QUINTIN QUENT QUINN
RACHEL: RACHAEL
RAYMOND: RAY
REBECCA: BECKY BECCA REBEKAH
RICHARD: RICK DICK RICH RICHIE RICKY
ROBERT: BOB ROB BOBBY ROBBIE BERT
RUTH: RUTHIE
SAMUEL: SAM SAMMY
SARAH: SARA SALLY
SERGEI: SERGEY SERGE SERGIO SERYOZHA
SIMON: SI
SOPHIA: SOFIA SOPHIE
STEPHEN: STEVE STEVEN STEPHAN STEFAN
SUSAN: SUE SUSIE SUZY SUZANNE
TARIQ: TAREK TARIK TAREQ
THEODORE: TED TEDDY THEO
THOMAS: TOM TOMMY
TIMOTHY: TIM TIMMY
URSULA: URSEL ULLA URSA URSIE
VICTORIA: VICKY VICKI TORI VIC VICTORINE
VIKRAM: VIK VICKRAM VIKKI
VINCENT: VINCE VINNY
VIRGINIA: GINNY
WALTER: WALT
WANDA: VANDA WANDY
WILLIAM: BILL WILL BILLY WILLY LIAM
XAVIER: XAVI JAVIER XAV
YVONNE: EVONNE IVONNE YVETTE VONNIE
ZACHARY: ZACK ZACH ZAC ZAK ZACHARIAH
ZOË: ZOE ZOEY
"""

# Titles that stand before a surname.
TITLES = (
    "MR MRS MS MISS MISTER MADAM DR DOCTOR PROF PROFESSOR JUDGE JUSTICE DETECTIVE OFFICER AGENT ATTORNEY SENATOR "
    "SERGEANT SGT CAPTAIN CAPT LIEUTENANT LT COLONEL COL MAJOR REV REVEREND SIR LADY LORD HON INSPECTOR CONGRESSMAN "
    "GOVERNOR PRINCE PRINCESS HERR FRAU SEÑOR SEÑORA MONSIEUR MADAME"
).split()


def formal_names() -> dict[str, tuple[str, ...]]:
    """Each given name or short form with the given names that it can stand for."""
    out: dict[str, list[str]] = {}
    for line in GIVEN_NAMES.strip().splitlines():
        formal, _, short = line.partition(":")
        out.setdefault(formal, []).insert(0, formal)
        for s in short.split():
            out.setdefault(s, []).append(formal)
    return {k: tuple(v) for k, v in out.items()}
