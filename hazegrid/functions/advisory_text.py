"""Official health-impact wording and the advisory templates per language."""

from __future__ import annotations

# Published health impact per band.
HEALTH_IMPACT = {
    "Good": "Minimal impact.",
    "Satisfactory": "Minor breathing discomfort to sensitive people.",
    "Moderate": "Breathing discomfort to people with lung disease such as asthma, and discomfort to people with heart disease, children and older adults.",
    "Poor": "Breathing discomfort to most people on prolonged exposure.",
    "Very Poor": "Respiratory illness on prolonged exposure.",
    "Severe": "Respiratory effects even on healthy people; serious health impacts on people with lung/heart disease. Health impacts may be experienced even during light physical activity.",
}

# Languages a city broadcasts in.
CITY_LANGUAGES = {"delhi": ["en", "hi"], "bengaluru": ["en", "kn"], "chennai": ["en", "ta"]}
LANGUAGE_NAMES = {"en": "English", "hi": "Hindi", "kn": "Kannada", "ta": "Tamil"}

# How each language's text was verified.
VERIFICATION = {"en": "cpcb_official", "hi": "native_speaker", "ta": "native_speaker", "kn": "cross_checked"}
SPEAKER_VERIFIED = ["cpcb_official", "native_speaker"]

# Advisory text by language and band.
TEMPLATES = {
    "en": {
        "Good": "Air quality in {ward} is good (AQI {aqi}). No precautions needed.",
        "Satisfactory": "Air quality in {ward} is satisfactory (AQI {aqi}). Sensitive individuals may feel minor breathing discomfort.",
        "Moderate": "Air quality in {ward} is moderate (AQI {aqi}). People with asthma or heart conditions, children and older adults should limit prolonged outdoor exertion.",
        "Poor": "Air quality in {ward} is POOR (AQI {aqi}). Most people may feel breathing discomfort on prolonged exposure. Reduce outdoor activity.",
        "Very Poor": "Air quality in {ward} is VERY POOR (AQI {aqi}). Avoid outdoor exertion. Keep windows closed. Use a mask outdoors.",
        "Severe": "Air quality in {ward} is SEVERE (AQI {aqi}). Avoid all outdoor activity. Even healthy people may be affected. Seek medical help if you have breathing difficulty.",
    },
    "hi": {
        "Good": "{ward} की हवा साफ़ है (AQI {aqi})। कोई दिक्कत नहीं।",
        "Satisfactory": "{ward} की हवा ठीक है (AQI {aqi})। जिन्हें साँस की दिक्कत रहती है, उन्हें थोड़ी परेशानी हो सकती है।",
        "Moderate": "{ward} की हवा ठीक नहीं है (AQI {aqi})। दमा या दिल की बीमारी वाले लोग, बच्चे और बुज़ुर्ग बाहर ज़्यादा देर मेहनत का काम न करें।",
        "Poor": "{ward} की हवा खराब है (AQI {aqi})। ज़्यादा देर बाहर रहने पर साँस लेने में दिक्कत हो सकती है। बाहर कम निकलें।",
        "Very Poor": "{ward} की हवा बहुत खराब है (AQI {aqi})। बाहर मेहनत का काम न करें। खिड़कियाँ बंद रखें। बाहर जाएँ तो मास्क पहनें।",
        "Severe": "{ward} की हवा बहुत ज़्यादा खराब है (AQI {aqi})। बाहर निकलने से बचें। सेहतमंद लोगों को भी दिक्कत हो सकती है। साँस लेने में परेशानी हो तो डॉक्टर को दिखाएँ।",
    },
    "ta": {
        "Good": "{ward} ல் காற்று நல்லா இருக்கு (AQI {aqi}). எந்த பிரச்சனையும் இல்லை.",
        "Satisfactory": "{ward} ல் காற்று பரவாயில்லை (AQI {aqi}). மூச்சு பிரச்சனை உள்ளவங்களுக்கு கொஞ்சம் சிரமம் இருக்கலாம்.",
        "Moderate": "{ward} ல் காற்று சரியில்லை (AQI {aqi}). ஆஸ்துமா அல்லது இதய நோய் உள்ளவங்க, குழந்தைங்க, வயசானவங்க வெளியே ரொம்ப நேரம் கஷ்டமான வேலை செய்ய வேண்டாம்.",
        "Poor": "{ward} ல் காற்று மோசமா இருக்கு (AQI {aqi}). ரொம்ப நேரம் வெளியே இருந்தா மூச்சு விட சிரமம் இருக்கும். வெளியே கம்மியா போங்க.",
        "Very Poor": "{ward} ல் காற்று ரொம்ப மோசமா இருக்கு (AQI {aqi}). வெளியே கஷ்டமான வேலை வேண்டாம். ஜன்னல்களை மூடி வையுங்க. வெளியே போனா மாஸ்க் போடுங்க.",
        "Severe": "{ward} ல் காற்று மிகவும் மோசமா இருக்கு (AQI {aqi}). வெளியே போறதை தவிர்க்கவும். நல்ல உடல்நலம் உள்ளவங்களுக்கும் பிரச்சனை வரலாம். மூச்சு விட சிரமம் இருந்தா டாக்டரை பாருங்க.",
    },
    "kn": {
        "Good": "{ward} ನಲ್ಲಿ ಗಾಳಿ ಚೆನ್ನಾಗಿದೆ (AQI {aqi}). ಯಾವುದೇ ತೊಂದರೆ ಇಲ್ಲ.",
        "Satisfactory": "{ward} ನಲ್ಲಿ ಗಾಳಿ ಸರಿ ಇದೆ (AQI {aqi}). ಉಸಿರಾಟದ ತೊಂದರೆ ಇರುವವರಿಗೆ ಸ್ವಲ್ಪ ತೊಂದರೆ ಆಗಬಹುದು.",
        "Moderate": "{ward} ನಲ್ಲಿ ಗಾಳಿ ಅಷ್ಟೇನು ಚೆನ್ನಾಗಿಲ್ಲ (AQI {aqi}). ಆಸ್ತಮಾ ಅಥವಾ ಹೃದಯದ ಸಮಸ್ಯೆ ಇರುವವರು, ಮಕ್ಕಳು ಮತ್ತು ವಯಸ್ಸಾದವರು ಹೊರಗೆ ಹೆಚ್ಚು ಹೊತ್ತು ಕಷ್ಟದ ಕೆಲಸ ಮಾಡಬೇಡಿ.",
        "Poor": "{ward} ನಲ್ಲಿ ಗಾಳಿ ಕೆಟ್ಟಿದೆ (AQI {aqi}). ಹೆಚ್ಚು ಹೊತ್ತು ಹೊರಗೆ ಇದ್ದರೆ ಉಸಿರಾಟಕ್ಕೆ ತೊಂದರೆ ಆಗಬಹುದು. ಹೊರಗೆ ಕಡಿಮೆ ಹೋಗಿ.",
        "Very Poor": "{ward} ನಲ್ಲಿ ಗಾಳಿ ತುಂಬಾ ಕೆಟ್ಟಿದೆ (AQI {aqi}). ಹೊರಗೆ ಕಷ್ಟದ ಕೆಲಸ ಮಾಡಬೇಡಿ. ಕಿಟಕಿಗಳನ್ನು ಮುಚ್ಚಿ ಇಡಿ. ಹೊರಗೆ ಹೋದರೆ ಮಾಸ್ಕ್ ಹಾಕಿ.",
        "Severe": "{ward} ನಲ್ಲಿ ಗಾಳಿ ಬಹಳ ಕೆಟ್ಟಿದೆ (AQI {aqi}). ಸಾಧ್ಯವಾದಷ್ಟು ಹೊರಗೆ ಹೋಗಬೇಡಿ. ಆರೋಗ್ಯವಾಗಿರುವವರಿಗೂ ತೊಂದರೆ ಆಗಬಹುದು. ಉಸಿರಾಟಕ್ಕೆ ತೊಂದರೆ ಇದ್ದರೆ ಡಾಕ್ಟರ್‌ನ್ನು ನೋಡಿ.",
    },
}

# Disclaimer parts.
DISCLAIMER_HEAD = "AQI band and health impact are the official CPCB NAQI classification. "
DISCLAIMER_REVIEWED = "All languages verified by a speaker of that language."
DISCLAIMER_OPEN = (
    "Text in {langs} has NOT been read by a native speaker — it is machine-written and cross-checked only. "
    "Get it reviewed before broadcasting."
)
