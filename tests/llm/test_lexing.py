"""Assignment-aware lexing on hand-made source and configuration lines, and on texts made to be slow."""

import time

import pytest

from sextant.llm.secrets import lex

K = "Xy7-kQ9z!pL2"
FOUND = [
    f'password = "{K}"', f"cfg['password'] = '{K}'", f'password = """{K}"""', f"password = '''{K}'''", f"auth:\n  password: |\n    {K}\n  user: bob\n",
    f"auth:\n  - token: >-\n      {K}\n", f"client = connect(host='h', password='{K}')", f'os.environ["API_KEY"] = "{K}"', f'const apiKey: string = "{K}";', f'password: str = "{K}"',
    f'password?: string = "{K}"', f'k = "{K}"\ndef f():\n    return 1\npassword = k', f'password = k\nk = "{K}"', f"<password>{K}</password>", f'<add key="password" value="{K}"/>',
    f'setPassword("{K}")', f'conf.set("db.password", "{K}")', f'token = os.getenv("TOKEN") or "{K}"', f'const secret = process.env.S || "{K}";', f'secret = a ?? "{K}"',
    f'api_key = str("{K}")', f"SECRET={K}", f"secret: {K}", f'{{"token": "{K}"}}', f"""body = '{{"password": "{K}"}}'""", f'# password = "{K}"', f'let it\'s fine. password = "{K}"',
    f'pass_phrase = "{K}"', f"password = b'{K}'", f'private static final String DB_PASSWORD = "{K}";', f'password => "{K}"', f':password => "{K}"', f'password := "{K}"',
    f'PASSWORD="{K}" ./run', f'#define API_KEY "{K}"', f'self.k = "{K}"\nx=1\nself.password = self.k', f'password = ("{K}")', f"accessKey = new String('{K}')", f'a = "{K}"\nb = a\nc = b\ntoken = c',
    f'class A {{ String k = "{K}"; void f() {{ password = k; }} }}', f'export GITHUB_TOKEN="{K}"', f"[db]\npasswd = {K}\nuser = x", f'def f():\n    k = "{K}"\n    password = k\n', f'"client-secret" : "{K}",',
    f'credentials = {{\n  user: "bob",\n  privateKey: "{K}"\n}}', f"def g(token='{K}'):\n    pass",
    f'DB_PASS="{K}"', f"ssh_key: '{K}'", f'hmacKey = "{K}"', f'smtp.pass = "{K}"', f'"deploy-key": "{K}"',
]
JOINED = [f'password = "{K}" + "zz1"', f'$password = "{K}" . "zz1";', f'password = ("{K}"\n  "zz1")', f'password = "{K}" \\\n  "zz1"', f'a = "{K}"\nb = "zz1"\npassword = a + b', f"secret: |\n  {K}\n  zz1\n"]
QUIET = [
    'password = getpass("Enter your password: ")', 'password = "changeme"', f'if password == "{K}":', "the secret to success: hard work", "token = self.next_token", "password = get_password()",
    'api_key = os.environ["API_KEY_NAME_1"]', f'def f():\n    k = "{K}"\n\ndef g():\n    password = k\n', f'function f() {{ var k = "{K}"; }}\nfunction g() {{ password = k; }}', "password: <your password>",
    f"name: {K}", "password = a\na = b\nb = a", 'token = ""', "secret = 12", 'password = "${DB_PASSWORD_1}"', "The password: it is written nowhere.", f'user = "{K}"', 'password = "aaaaaaaaaaaa"', "api_key: null", "token => ",
    f'primary_key = "{K}"', f'sort-key: "{K}"', f'compass = "{K}"', f'bypass_reason = "{K}"', f'public_key = "{K}"', f'key = "{K}"',
]


def spans(text):
    return [text[a:b] for a, b in lex(text)]


@pytest.mark.parametrize("text", FOUND)
def test_literal_is_found(text):
    assert spans(text) == [K]


@pytest.mark.parametrize("text", JOINED)
def test_parts_of_a_value_are_found(text):
    assert spans(text) == [K, "zz1"]


@pytest.mark.parametrize("text", QUIET)
def test_nothing_is_found(text):
    assert spans(text) == []


@pytest.mark.parametrize(
    "text",
    [
        'a0 = "x1Yz"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, 5000)) + "password = a4999\n",
        "".join(f"a{i} = a{i + 1} + 'b{i}'\n" for i in range(5000)) + "a5000='z9'\npassword = a0\n",
        "password=" * 20000, "<a>" * 50000, "(a=" * 30000, "{" * 50000, "a: b, " * 30000, '"""' * 30000, "password: |\n" + "  x\n" * 50000, "k = |\n" * 20000, "token:" + " " * 200000, "'" * 100000,
        'x: "a=\\"b: c\\""\n' * 5000,
    ],
)
def test_linear_time(text):
    begun = time.time()
    lex("token " + text)
    assert time.time() - begun < 10


def test_passwords_of_addresses():
    from sextant.llm.secrets import scan_text

    of = lambda text: [text[a:b] for a, k, b in scan_text(text) if k == 3]
    assert of('conn = "postgres://bob:Zx9kk2lmnQ7@db.example.com/x"') == ["Zx9kk2lmnQ7"]
    assert of("amqp://:Zx9kk2lmnQ7@[::1]:5672") == ["Zx9kk2lmnQ7"]
    assert of('url = "https://h/a:b@c" see http://host:8080/x@y and ftp://u:short@h, https://u:${PASSWORD_1}@h') == []
    begun = time.time()
    scan_text("a://" + "b:" * 300_000 + "x" * 300_000)
    assert time.time() - begun < 10
