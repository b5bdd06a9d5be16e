"""Where logs come from and where stores keep them: tables, binary log files, folders and HTTP."""
